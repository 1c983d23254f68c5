"""Rows of null and repeated ids keep their own redactions and their own verdicts."""

from tessera.llm.perplexity import kept_by_quality, quality
from tessera.llm.secrets import redacted
from tests.llm.test_operators import docs, labels, repeated, texts  # noqa: F401


def test_redacted_repeated(spark, docs, repeated):  # noqa: F811
    clean = {r.doc_id: r.text for r in redacted(docs).collect()}
    by_text = {t: clean[i] for i, t in enumerate(texts())}
    both = redacted(repeated).select("doc_id", "text").collect()
    assert sorted(str(tuple(r)) for r in both) == sorted(str((i, by_text[t])) for i, t in ((r.doc_id, r.text) for r in repeated.collect()))
    one, two = "password = abcDEF123456789 x", "long words before token: A1b2C3d4E5f6G7h8"
    df = spark.createDataFrame([(None, one, "a"), (None, two, "b"), (None, None, "c"), (None, "plain", "d"), (7, one, "e"), (7, two, "f")], "doc_id long, text string, source string")
    got = sorted((str(r.doc_id), r.text or "") for r in redacted(df).collect())
    first, second = "password = [secret] x", "long words before token: [secret]"
    assert got == sorted([("None", first), ("None", second), ("None", ""), ("None", "plain"), ("7", first), ("7", second)])


def test_kept_by_quality_repeated(repeated, labels):  # noqa: F811
    judged = [(str(r.doc_id), r.lang, r.n_bytes) for r in quality(repeated, labels).collect() if r.kept]
    got = kept_by_quality(repeated, labels).collect()
    assert sorted((str(r.doc_id), r.lang or "", len((r.text or "").encode())) for r in got) == sorted(judged)
    assert not any(r.text in (None, "") for r in got) and any(r.doc_id is None for r in got)
