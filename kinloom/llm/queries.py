"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op5_bpe
from .decontaminate import OP3_SQL, op3_decontamination
from .html_extract import op1_html
from .langid import op4_langid
from .quality import op6_quality
from .secret_scan import OP2_SQL, op2_secrets
from .sharding import OP10_SQL, op10_sharding
from .simhash import op7_simhash
from .url_filter import op8_urls
from .warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_html, op2_secrets, op3_decontamination, op4_langid, op5_bpe, op6_quality, op7_simhash, op8_urls, op9_warc, op10_sharding)}
ORACLES = {"op2_secrets": OP2_SQL, "op3_decontamination": OP3_SQL, "op9_warc": OP9_SQL, "op10_sharding": OP10_SQL}
