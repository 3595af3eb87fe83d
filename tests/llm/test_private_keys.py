"""Redaction of keys of several lines."""

import pytest

from tablescope.llm import secrets

HEAD, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
LINES = ["MIIEpAIBAAKCAQEA" + "aB3+/9Zk" * 6 for _ in range(4)]
KEYS = {
    "whole": "\n".join([HEAD, *LINES, "Zm9v", END]), "windows": "\r\n".join([HEAD, *LINES, "Zg==", END]),
    "escaped": "\\n".join([HEAD, *LINES, "Zg==", END]), "fields": "\n".join([HEAD, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00FF", "", *LINES, END]),
    "no end": "\n".join([HEAD, *LINES, "Zm9v="]), "header only": HEAD,
}


@pytest.mark.parametrize("name", KEYS)
def test_no_line_of_a_key_stays(spark, name):
    docs = spark.createDataFrame([(1, f"before\n{KEYS[name]}\n\nplain words, after it.")], "doc_id long, text string")
    assert secrets.redact(docs).first()["text"] == "before\n[SECRET]\n\nplain words, after it."


@pytest.mark.parametrize("name", KEYS)
def test_spans_hold_what_redaction_removes(spark, name):
    text = f"before\n{KEYS[name]}\n\nplain words, after it."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [tuple(s) for s in secrets.find_secrets(docs).first()["spans"] if s["kind"] == "private_key"]
    assert spans == [("private_key", 7, 7 + len(KEYS[name]))]
