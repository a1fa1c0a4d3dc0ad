"""The registered text queries: against their SQL, and the pipeline against
its operators run one after the other."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import digest, duck
from evolve.llm import line_dedup, ngram_join, packing, quality_rules, secrets
from evolve.llm.oracle import SQL
from evolve.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(QUERIES)
    assert sorted(n.split("_")[0] for n in QUERIES if n != "pipeline") == sorted(f"op{i}" for i in range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF_SMALL).execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert digest(rows, df.columns) == digest(cur.fetchall(), cols)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    lines = line_dedup.dedup(kept)
    assert lines.columns == docs.columns and lines.count() == kept.count()
    single = ngram_join.one_of_each(lines)
    clean = secrets.redacted(single)
    assert clean.columns == docs.columns
    want = packing.packing(clean)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.collect() == []


def test_pipeline_links_near_copies_from_four_fifths(spark):
    """Similarities between 0.80 and 0.85 of five-word shingles, and one below."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, words), (2, words + [f"a{i}" for i in range(90)]), (3, [f"x{w}" for w in words]),
            (4, [f"x{w}" for w in words[:200]] + [f"b{i}" for i in range(35)] + [f"x{w}" for w in words[235:]]),
            (5, [f"y{w}" for w in words]), (6, [f"y{w}" for w in words] + [f"c{i}" for i in range(110)])]

    def similarity(a, b):
        a, b = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        return len(a & b) / len(a | b)
    text = dict(rows)
    assert all(.8 <= similarity(text[a], text[a + 1]) < .85 for a in (1, 3)) and similarity(text[5], text[6]) < .8
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF_SMALL).collect()) == [1, 3, 5, 6]
