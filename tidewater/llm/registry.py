"""What the driver's entry module registers from this subpackage."""

from __future__ import annotations

import corpus_pipeline
from tidewater.llm import queries as own


def queries():
    return dict(own.QUERIES) | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    pipeline = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return dict(own.ORACLE) | pipeline
