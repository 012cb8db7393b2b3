"""The queries of this subpackage by name, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from corpusmill.llm import sql
from corpusmill.llm.decontamination import op5_decontamination
from corpusmill.llm.langid import op1_language_id
from corpusmill.llm.near_dups import op9_near_dups
from corpusmill.llm.pieces import op2_sentencepiece
from corpusmill.llm.pii import op7_pii
from corpusmill.llm.quality import op4_quality
from corpusmill.llm.secret_scan import op8_secrets
from corpusmill.llm.suffix_dedup import op3_suffix_dedup
from corpusmill.llm.topk import OP10_SQL, op10_topk
from corpusmill.llm.toxicity import op6_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_sentencepiece, op3_suffix_dedup, op4_quality, op5_decontamination,
        op6_toxicity, op7_pii, op8_secrets, op9_near_dups, op10_topk,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_suffix_dedup": sql.OP3, "op5_decontamination": sql.OP5, "op9_near_dups": sql.OP9, "op10_topk": OP10_SQL}
