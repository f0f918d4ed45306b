import re

from brute import spark_hash

from textloom.llm import secrets

TEXTS = [
    None, "", "nothing here", 'password = "abcdef"', "Password:'short", "tok token=token\"=abcdef", "api_key: x9/+=-._A", "APIKEY=abcdefgh token=12345 secret :  zzzzzz",
    "AKIA" + "A" * 16 + " AKIAAAA AKIAAKIA" + "B" * 30, "0123456789abcdef" * 2 + "g" + "a" * 23, "é😀 secret=\U0001f600abcdef token = 0123456789abcdef0123456789abcdef",
    "passwd=secret=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "https://user:pass@host/x", "K" * 50 + "token=abcdef",
    "-----BEGIN " + "VERY " * 30 + "PRIVATE KEY-----", "ftp://" + "u" * 500 + ":" + "p" * 500 + "@host averylongschemenamethatgoeson://u:p@h", "Bearer" + " " * 9 + "a" * 30, "hexonly " + "f" * 30,
    "x" * 200_000 + " secret=abcdef1 " + "f" * 30,
]


def brute(text):
    text = text or ""
    out = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = r"[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), rank, m.end(), rule.kind))
    return sorted(out)


def test_spans_against_brute_force(spark, monkeypatch):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as spans", "2 as met", "3 as text_hash")
    out = secrets.scan(df)
    assert out.columns == [*df.columns, "spans_"]
    got = sorted(((r["doc_id"], r["text"], [tuple(s) for s in r["spans_"]]) for r in out.collect()), key=repr)
    assert got == sorted(((i, t, brute(t)) for i, t in rows), key=repr)
    monkeypatch.setattr(secrets, "MOST_KEYS", 0)
    assert sorted(((r["doc_id"], r["text"], [tuple(s) for s in r["spans_"]]) for r in secrets.scan(df).collect()), key=repr) == got


def test_queries_hold_for_every_match():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for t in TEXTS:
            for m in re.finditer(rule.pattern, t or "", re.ASCII):
                assert met(query, m.group().lower())
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is True
    assert secrets.trigram_query(r"ab") is True
    assert secrets.trigram_query(r"abcd?x") == ("or", (("and", ("abc", "bcd", "cdx")), ("and", ("abc", "bcx"))))


def met(query, text):
    if query is True or isinstance(query, str):
        return query is True or query in text
    return (all if query[0] == "and" else any)(met(q, text) for q in query[1])


def test_posting_lists_and_what_they_answer(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    lists = secrets.posting_lists(df)
    by_hash = {spark_hash(t): i for i, t in enumerate(TEXTS)}
    expected = {(g, i) for g in secrets.vocabulary() for i, t in enumerate(TEXTS) if g in (t or "").lower()}
    assert {(r["trigram"], by_hash[r["text_hash"]]) for r in lists.collect()} == expected
    queries = [secrets.trigram_query(r.pattern) for r in secrets.RULES] + [("or", ("abc", ("and", ("tok", "ken"))))]
    rules = (*secrets.RULES, secrets.Rule("x", "abc|token"))
    grams = secrets.vocabulary(rules)
    lists = secrets.posting_lists(df, rules=rules)
    assert all(grams[r["number"]] == r["trigram"] for r in lists.collect())
    got = {by_hash[r["text_hash"]]: r["met"] for r in secrets.ask(lists, queries, grams).collect()}
    for i, t in enumerate(TEXTS):
        assert got.get(i, []) == [n for n, q in enumerate(queries) if q is not True and met(q, (t or "").lower())]
    assert secrets.ask(lists, [True], grams).count() == 0


def test_empty(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
