"""Each query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import os
import re

import duckdb
import pytest

from lumenlog.functions import text as T
from lumenlog.plans import analytics, catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, decimal.Decimal):
            return str(x.normalize())
        if isinstance(x, datetime.datetime):
            return x.replace(tzinfo=None)
        return tuple(map(value, x)) if isinstance(x, (list, tuple)) else x

    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


def test_the_catalogue_holds_the_analyses():
    assert analytics.denial_flags is catalogue.QUERIES["denial_flags"]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(found.fetchall(), columns)


#: DuckDB has no lookahead, so SQL can only say what becomes of texts whose volatile tokens are all plain numbers.
NUMBERS = r"SELECT doc_id, regexp_replace(text, '\b\d+\b', '<NUM>', 'g') AS masked FROM documents WHERE NOT regexp_matches(text, '[/\\]|[0-9a-fA-F]{8}|0[xX]|\d{4}-\d\d')"
PLAIN = re.compile(
    r"""(?P<TS>\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)
    |(?P<UUID>[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})
    |(?P<HEX>0[xX][0-9a-fA-F]+|\b(?=[0-9a-fA-F]{8,}\b)(?=[0-9]*[a-fA-F])[0-9a-fA-F]+)
    |(?P<PATH>(?:/[\w.\-]+){2,}|(?:[A-Za-z]:)?(?:\\[\w.\-]+){2,})
    |(?P<NUM>\b\d+\b)""",
    re.X,
)


def plain_mask(text):
    return None if text is None else PLAIN.sub(lambda m: f"<{m.lastgroup}>", text)


def test_mask_equals_plain_python_on_every_token_type(spark):
    tokens = {
        "TS": ["2024-01-02T03:04:05", "2024-01-02 03:04:05.678Z", "2024-01-02 03:04:05+0130", "2024-01-02T03:04:05-01:30"],
        "UUID": ["123e4567-e89b-12d3-a456-426614174000", "ABCDEFAB-0000-1111-2222-0123456789AB"],
        "HEX": ["0x1A2B", "0Xff", "deadbeef", "12345678a", "0123456789abcdef0123456789abcdef"],
        "PATH": ["/usr/lib", "/a/b-c/d.txt", "C:\\temp\\x.log", "\\host\\share", "/été/naïve"],
        "NUM": ["7", "12345678", "1700000000000", "٣٤"],
    }
    alone = [(f"at {t} end", f"at <{kind}> end") for kind, listed in tokens.items() for t in listed]
    flat = [t for listed in tokens.values() for t in listed]
    mixed = [f"{a}{gap}{b}" for a in flat for b in flat for gap in (" ", "", "-", "_", "/", ", ")]
    odd = [None, "", " ", "none here", "x12 12x é1 1é", "2024-01-02", "/one", "deadbee", "0x", "\\", "a\n1\n\n2\t3", "日本5語 6", "🤦1🤦 2"]
    texts = [t for t, _ in alone] + mixed + odd
    got = {r.i: r.m for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.mask("t").alias("m")).collect()}
    assert [got[i] for i in range(len(alone))] == [want for _, want in alone]
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, plain_mask(t)) for t in texts]


def test_mask_full_covers_all_documents(spark, duck):
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    assert all(q(spark, DATA).count() == len(texts) for name, q in catalogue.QUERIES.items() if name.startswith("mask"))
    got = {r.doc_id: r.masked for r in catalogue.QUERIES["mask_full"](spark, DATA).collect()}
    assert got == {i: plain_mask(t) for i, t in texts.items()}
    numbers = dict(duck.execute(NUMBERS).fetchall())
    assert 0 < len(numbers) < len(got) and all(got[i] == masked for i, masked in numbers.items())
