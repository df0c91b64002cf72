"""Reading corpora and rankings, writing results."""
