"""All queries of the package: importing the modules registers them."""

from fleetlens.llm import chat_format, decontaminate, hard_negatives, language, licenses, line_dedup, ngram_join, packing, perplexity, pseudonyms, token_files, whitening, winnow  # noqa: F401
from fleetlens.llm.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
