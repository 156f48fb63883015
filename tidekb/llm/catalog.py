"""Every corpus operator as a registered query, with its SQL where there is one."""

from tidekb.llm import exactdedup, langid, licenses, lmscore, merkle, mixing, nearvec, ngramjoin, periodic, pieces, topk, urlgraph, warc  # noqa: F401
from tidekb.llm.common import ORACLE, QUERIES  # noqa: F401
