"""Registered queries against their DuckDB oracle SQL (the driver's correctness gate, locally)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# a fast, representative subset at sf0.001 (the full set runs in tools_oracle_check.py)
KEYS = ["auroc", "roc_curve", "rank_normalise", "cohort", "merge_comments", "split_assign",
        "oversample", "nb_fit", "fold_report", "consensus_top", "example_report", "row_index",
        "score_report_invalid", "survey_scan", "tsv_roundtrip", "ranked_listing", "rank_report", "drop_empty_comment"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (round(v, 6) + 0.0)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_callable():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 60
    # every query of the workflow has an oracle; the training-data operators say themselves which have none
    from textcohort.plans.registry import ORACLE, QUERIES
    assert set(QUERIES) == set(ORACLE) and set(sql) <= set(qs)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["fold", "auroc", "auprc", "pearson"]
    folds = {f"fold{i}" for i in range(10)}
    assert len(rows) == 12 and {r["fold"] for r in rows} == folds | {"avg", "median"}
