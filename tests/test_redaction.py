"""Redaction of whole documents, phone numbers too: what each text becomes, written out."""

import hashlib

from tessera.plans.queries import queries

CLEAN = {
    None: "",
    "": "",
    "  plain  words ": "plain words",
    "call +54 11 5555-1234 now": "call [redacted-phone] now",
    "(011) 4444-5555 and 12345678901234": "([redacted-phone] and [redacted-phone]",
    "x12345678901 12345678901x": "x12345678901 12345678901x",
    "a@b.org https://x.y/1234567890123 2024-01-02 10": "[redacted-email] [redacted-url] [redacted-phone]",
    "1 2 3 4 5 6 7 8 9 0": "[redacted-phone]",
    "tel 555.123.4567, fax 555.123.4568": "tel [redacted-phone], fax [redacted-phone]",
    "y" * 990 + " 011 4444 5555 6666": "y" * 990 + " [redacted",
    "no. 1234567": "no. 1234567",
}


def test_all_documents_are_redacted(spark, tmp_path):
    spark.createDataFrame(list(enumerate(CLEAN)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.clean for r in queries()["X03_redacted_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(c.encode()).hexdigest() for i, c in enumerate(CLEAN.values())}
