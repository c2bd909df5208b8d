import hashlib
import random
import re

from tablewright.llm import secret_scan as S

PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def brute(text):
    out = []
    for rank, (kind, (pattern, ok)) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if ok(m)]
    return sorted(out)


def told(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


def texts():
    rng = random.Random(6)
    parts = ["é", "\U0001f600", "token", "TOKEN = ", "Secret: ", 'api_key="', "apiKey':'", "passwd=", "password", "=", ": ", '"', "'", " ", "\n", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", "abc", "XYZ_", "short", "a" * 11, "b" * 12, "-", "ſecret=abcdefghijklmnop", "toKen = 'abcdefghijkl'"]
    out = ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(400)]
    return out + ["", None, "token: secret= abcdefghijklmnopqr", "token=secret=abcdefghijklmnop", "AKIA" * 9, "x" * 200_000 + " token=" + "y" * 20, "token=abcdefghijklmnop " * 3000]


def test_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "token=abcdefghijklmnop"), (1, "token=abcdefghijklmnop"), (1, "token=abcdefghijklmnop")]
    df = spark.createDataFrame([(d, t, "p", "k") for d, t in rows], "doc_id long, text string, blob string, kind string")
    want = []
    for d, t in rows:
        found = brute(t)
        n = [sum(f[2] == k for f in found) for k in PATTERNS]
        want.append((d, *n, hashlib.sha256(told(found).encode()).hexdigest(), told(found)))
    assert sorted(map(tuple, S.find_secrets(df, rules=()).collect()), key=str) == sorted(want, key=str)


def test_more_rules(spark):
    text = "x -----BEGIN RSA PRIVATE KEY----- eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh_12 secret=abcdefghijklmnop"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = S.find_secrets(df).collect()[0]
    assert row.spans == "pem:2:33,jwt:34:71,assign:72:95" and row.n_assign == 1 and row.base_sha256 == hashlib.sha256(b"assign:72:95").hexdigest()


def test_ledger_is_incremental(spark, tmp_path):
    ledger = f"{tmp_path}/ledger"
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(1, "token=abcdefghijklmnop"), (2, "nothing"), (3, "nothing")], schema)
    S.find_secrets(first, ledger, ()).collect()
    rows = lambda: spark.read.parquet(ledger).count()
    assert rows() == 2 * 3
    again = S.find_secrets(first, ledger, ()).orderBy("doc_id").collect()
    assert rows() == 6 and [r.spans for r in again] == ["assign:0:22", "", ""]
    more = spark.createDataFrame([(7, "nothing"), (8, "new 0123456789abcdef")], schema)
    assert [r.spans for r in S.find_secrets(more, ledger, ()).orderBy("doc_id").collect()] == ["", "hex:4:20"] and rows() == 9
    rule = S.Rule("word", r"new|nothing")
    assert [r.spans for r in S.find_secrets(more, ledger, (rule,)).orderBy("doc_id").collect()] == ["word:0:7", "word:0:3,hex:4:20"] and rows() == 11


def test_only_unseen_texts_are_scanned(spark, tmp_path, monkeypatch):
    """On a second run, the texts that reach the scan are those of new blobs."""
    ledger, reached, scan = f"{tmp_path}/ledger", [], S._scan
    monkeypatch.setattr(S, "_scan", lambda texts, rules: scan(reached.append(sorted(r.text for r in texts.collect())) or texts, rules))
    docs = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old = [f"text {k} token=abcdefghijklmnop{k}" for k in range(20)]
    S.find_secrets(docs(old), ledger, ()).collect()
    got = S.find_secrets(docs([*old[:5], "new one", None, "new one"]), ledger, ()).collect()
    assert reached == [sorted(old), ["", "new one"]] and len(got) == 8 and sum(r.n_assign for r in got) == 5
    # broadcast or not, the same
    monkeypatch.setattr("tablewright.llm.common.BROADCAST_ROWS", 0)
    got = S.find_secrets(docs([*old, "newer", "newer"]), ledger, ()).collect()
    assert reached[2] == ["newer"] and sum(r.n_assign for r in got) == 20
    # the ledger's other blobs aren't joined
    assert S.scan(docs(["newer"]), ledger, S.BASE).count() == 1


def test_sql_folds_ascii_only(spark):
    import duckdb
    from tablewright.llm.oracles import SECRETS

    found = duckdb.connect()
    found.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, '\u017fecret=abcdefghijklmnop'), (2, 'SeCret=abcdefghijklmnop')) AS t(doc_id, text)")
    want = {r[0]: r[1] for r in found.execute(f"SELECT doc_id, spans FROM ({SECRETS})").fetchall()}
    docs = spark.createDataFrame([(1, "\u017fecret=abcdefghijklmnop"), (2, "SeCret=abcdefghijklmnop")], "doc_id long, text string")
    assert want == {r.doc_id: r.spans for r in S.find_secrets(docs).collect()} == {1: "", 2: "assign:0:23"}


def test_empty(spark):
    assert S.find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []
