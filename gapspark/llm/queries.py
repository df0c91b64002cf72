"""The queries of this subpackage and, where SQL can express them, their SQL."""

from gapspark.llm.codes import OP11_SQL, op11_codes
from gapspark.llm.decontaminate import OP3_SQL, op3_decontaminate
from gapspark.llm.html import op8_html
from gapspark.llm.language import op6_language
from gapspark.llm.lines import OP13_SQL, op13_lines
from gapspark.llm.pieces import op7_sentencepiece
from gapspark.llm.quality import op10_quality
from gapspark.llm.resample import OP12_SQL, op12_resample
from gapspark.llm.secrets import OP2_SQL, op2_secrets
from gapspark.llm.sharding import op4_sharding
from gapspark.llm.simhash import op1_simhash
from gapspark.llm.tokens import op9_tokens
from gapspark.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_decontaminate": op3_decontaminate,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_html": op8_html,
    "op9_tokens": op9_tokens,
    "op10_quality": op10_quality,
    "op11_codes": op11_codes,
    "op12_resample": op12_resample,
    "op13_lines": op13_lines,
}

ORACLES = {
    "op2_secrets": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op11_codes": OP11_SQL,
    "op12_resample": OP12_SQL,
    "op13_lines": OP13_SQL,
}
