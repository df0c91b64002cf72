"""Extensions over streams; nothing here is needed by the batch pipelines."""
