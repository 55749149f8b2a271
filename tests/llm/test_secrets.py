import re

from tempolens.llm import secrets
from tempolens.llm.queries import op3_secret_scan

from .helpers import ROWS, frame, got, save, sha

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
COLS = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
HEX = "0123456789abcdef" * 2
SECRETS = [
    (100, f"token=abc password : 'longer-one' {HEX} AKIA{'Z9' * 9}"), (101, "password=token: abcdefgh"), (102, "API_KEY=\"x.y.z-12\" apikey==abcdef"),
    (103, f"é{HEX}é AKIAAKIA{'A' * 12} AKIA{'A' * 15}"), (104, "secret=secret=secret=abcdef token  =  'ab" + "c" * 5), (105, "x" * 5000 + " user: bob " + "k9" * 3),
    (106, "login=alice https://db.example.com/x password=hunter22"), (107, "login=alice and nothing more"), (108, "https://only.example.com/"),
    (109, "user: carol " + "word " * 80 + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hI"), (110, "user: carol aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hI"),
    (111, "PASSWORD=" + HEX * 40),
]


def brute(rows):
    out = []
    for d, t in rows:
        spans, n = [], []
        for k, (kind, (rx, g, least)) in enumerate(BASE.items()):
            found = [m for m in rx.finditer(t or "") if len(m.group(g)) >= least]
            n.append(len(found))
            spans += [(m.start(), k, m.end(), kind) for m in found]
        out.append((d, *n, sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)))))
    return sorted(out, key=repr)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert sum(r[1] for r in want)
    assert got(op3_secret_scan(spark, sf), *COLS) == want


def test_edges(spark, tmp_path):
    rows = ROWS + SECRETS + SECRETS[:2]
    docs = frame(spark, rows).repartition(3).selectExpr("*", "1 as id", "2 as rk", "'x' as spans", "3 as kind")
    out = op3_secret_scan(spark, save(tmp_path, documents=docs))
    assert got(out, *COLS) == brute(rows)
    assert secrets.scan_secrets(frame(spark, [])).count() == 0


def test_weak_parts_need_their_complement(spark):
    rows = {r.doc_id: [(s["name"], s["start"], s["end"]) for s in r.spans] for r in secrets.scan_secrets(frame(spark, SECRETS)).collect()}
    assert [s[0] for s in rows[106]] == ["login", "endpoint", "assign"]
    assert rows[107] == rows[108] == rows[109] == []
    assert [s[0] for s in rows[110]] == ["login", "opaque"]
    assert [s[0] for s in rows[105]] == []


def test_scope_is_exact(spark):
    opaque = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hI"
    rows = [(n, "user: carol" + " " * n + opaque + " " * n + "user: dave") for n in (1, 60, 255, 256, 257, 258, 400)]
    out = {r.doc_id: {s["name"] for s in r.spans} for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert {d for d, s in out.items() if s} == {1, 60, 255, 256}


def test_only_jvm_operators(spark):
    plan = op3_secret_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
