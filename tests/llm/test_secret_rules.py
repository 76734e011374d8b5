"""Secret rules with literals beyond ASCII (op9)."""

from __future__ import annotations

from tabwright.llm import secret_scan
from tests.llm.helpers import table


def test_rules_beyond_ascii(spark):
    rules = [
        secret_scan.Rule("word", r"clé[0-9]{4}"),
        secret_scan.Rule("upper", r"ÉTÉ-KEY-[0-9]+"),
        secret_scan.Rule("han", r"(?:密码是|口令是)[a-z]+"),
        secret_scan.Rule("kelvin", r"abc\u212ad"),
    ]
    texts = ["x clé1234 y", "ÉTÉ-KEY-77", "密码是abc 口令是xyz", "abc\u212ad", "cle1234 abckd"]
    got = secret_scan.scan(table(spark, list(enumerate(texts))), rules).collect()
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got}
    assert found == {
        0: [("word", 2, 9)],
        1: [("upper", 0, 10)],
        2: [("han", 0, 6), ("han", 7, 13)],
        3: [("kelvin", 0, 5)],
        4: [],
    }
    assert secret_scan.trigrams_of(secret_scan.trigram_query(r"abc\u212adef")) == {"abc", "def"}
