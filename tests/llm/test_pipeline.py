"""The pipeline's stages one after the other on a small corpus."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(3)
    vocab = {"de": "und der die nicht schön über zwischen haus", "en": "the and with from this there would house", "es": "que los para niño mañana entre esta casa", "fr": "les des être où français avec dans maison"}
    rows = []
    for i in range(160):
        x = ("de", "en", "es", "fr")[i % 4]
        rows.append((i, " ".join(rng.choice(vocab[x].split()) for _ in range(60)) + "\nEvery one of these documents has this line", x, f"s{i % 3}", 300))
    rows += [(200, rows[0][1], "de", "s0", 300), (201, None, "de", "s0", None), (202, "", None, None, 0), (203, rows[1][1][::-1].split("\n")[1][::-1] + " again\n" + rows[0][1].split("\n")[1], "en", "s0", 300)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    return at


def test_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.mode("overwrite").parquet(f"{sf_dir}/out-{name}")
        docs = spark.read.parquet(f"{sf_dir}/out-{name}")
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda n: {r["doc_id"] for r in seen[n].select("doc_id").collect()}
    assert ids("language_id") == set(range(160)) | {200, 203}
    lines = {r["doc_id"]: r["text"].split("\n")[1:] for r in seen["line_dedup"].collect()}
    assert [i for i, rest in lines.items() if rest] == [203]
    assert not {0, 200} <= ids("simhash_near_dedup") and len(ids("simhash_near_dedup")) >= 150
    mixed = seen["source_mixing"].count()
    assert mixed == seen["bpe"].count() and 0.5 * 160 < mixed < 1.5 * 160
    assert seen["bpe"].where("not round_trip or n_tokens = 0").count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, stage):
    """Nulls, empty texts, ties, repeated rows and further columns with clashing names, in every stage."""
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    text = "und der die nicht schön über zwischen haus " * 4
    rows = [(1, text, "de", "s", 3), (1, text, "de", "s", 3), (1, "the and with from this there would house " * 4, "en", None, 3), (None, text, None, "s", None), (2, None, None, None, None), (3, "", "xx", "s", 0), (4, " \n\n", "de", "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("ids", "fingerprint", "n_lines", "lang_id", "copy", "th", "doc", "fp")})
    out = p.STAGES[stage][1](spark, docs, "")
    assert stage == 4 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = sorted(((r["doc_id"], r["text"] if stage < 4 else r["n_tokens"] > 0) for r in out.collect()), key=repr)
    if stage == 0:
        assert got == sorted([(i, t) for i, t, *_ in rows if (t or "").strip()], key=repr)
    elif stage == 1:
        assert got == sorted([(i, t or "") for i, t, *_ in rows], key=repr)
    elif stage == 2:
        assert got == sorted([(1, rows[0][1]), (1, rows[2][1]), (2, None)], key=repr)
    elif stage == 3:
        assert {g[0] for g in got} <= {1, 2, 3, 4, None}
    else:
        assert got == sorted([(i, bool(t)) for i, t, *_ in rows], key=repr)


def test_empty(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in p.STAGES] and p.ORACLE_SQL is None
    