import hashlib
import re

from larder.llm import secrets
from tests.llm.data import docs, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def said(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def linked_spans(text, base, reach=secrets.REACH):
    """Every pair of parts of a scope, looked at."""
    text = text or ""
    parts, breaks = list(base), []
    for m in re.finditer(secrets.WEAK, text):
        if m[0].startswith("\n"):
            breaks.append(m.start())
            continue
        no = 5 if re.match(r"https?://|jdbc:", m[0]) else 3 if re.match(r"""(?i:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]""", m[0]) else 4
        if not any(a < m.end() and m.start() < b for a, _, b in base):
            parts.append((m.start(), no, m.end()))
    scope = lambda p: sum(b < p[0] for b in breaks)
    role = {0: "s", 1: "i", 2: "s", 3: "i", 4: "s", 5: "e"}
    out = []
    for p in parts:
        if p[1] < 3:
            continue
        near = {role[q[1]] for q in parts if role[q[1]] != "e" and role[q[1]] != role[p[1]] and scope(q) == scope(p) and abs(q[0] - p[0]) <= reach}
        near_all = {role[q[1]] for q in parts if role[q[1]] != "e" and scope(q) == scope(p) and abs(q[0] - p[0]) <= reach}
        if (p[1] == 5 and near_all == {"i", "s"}) or (p[1] < 5 and near):
            out.append(p)
    return out


def check(df):
    got = secrets.digest(secrets.find_secrets(df)).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        base = base_spans(r.text)
        every = sorted(base + linked_spans(r.text, base))
        n = [sum(k == i for _, k, _ in base) for i in range(3)]
        want.setdefault(r.doc_id, set()).add((*n, hashlib.sha256(said(base).encode()).hexdigest(), said(every)))
    for g in got:
        assert (g.n_assign, g.n_access, g.n_hex, g.base_sha256, g.spans) in want[g.doc_id], g
    return got


def test_given_documents(spark):
    assert sum(g.n_assign for g in check(table(spark, "documents"))) > 10


def test_odd_cases(spark):
    check(docs(spark))
    assert secrets.digest(secrets.find_secrets(docs(spark).where("false"))).count() == 0


def test_linking(spark):
    weak = "user: alice\npwd=hunter22\nhttps://db.example.org/x"
    far = "user: alice " + "x " * 600 + " pwd=hunter22"
    texts = [weak, "pwd=hunter22 only", far, "user: alice\n\npwd=hunter22", "token=token:abcdefgh secret: pass PASSWORD = 'aB3.xyz9'", " ".join(f"user: u{i} pwd=p{i}aaa" for i in range(400)), "é" * 50 + " login=bob AKIA" + "Z" * 20, "aKIA apikey:deadbeef" + "0123456789abcdef" * 3]
    rows = [(i, t, "en", "s", 1, 1, "k", 1) for i, t in enumerate(texts)]
    got = {g.doc_id: g.n_linked for g in check(docs(spark, rows))}
    assert [got[i] for i in range(4)] == [3, 0, 0, 0] and got[5] == 800 and got[6] == 0


def test_linking_of_strong_parts_and_null_ids(spark):
    strong = "AKIA" + "Z" * 16 + " secret=abcdefgh https://db.example.org/x"
    hexed = "AKIA" + "Z" * 16 + " " + "0123456789abcdef" * 2 + " https://db.example.org/x"
    texts = [(0, strong), (1, hexed), (2, strong.replace(" https", "\n\nhttps")), (3, "secret=abcdefgh https://db.example.org/x"), (None, "user: alice pwd=hunter22"), (None, strong)]
    df = docs(spark, [(i, t, "en", "s", 1, 1, "k", 1) for i, t in texts])
    got = sorted((-1 if g.doc_id is None else g.doc_id, g.n_linked) for g in check(df))
    assert got == [(-1, 1), (-1, 2), (0, 1), (1, 1), (2, 0), (3, 0)]
    assert all("https" not in r.text for r in secrets.redact(df).where("doc_id in (0, 1)").collect())


def test_redaction(spark):
    df = docs(spark)
    out = {r.doc_id: r.text for r in secrets.redact(df).collect() if r.doc_id is not None}
    assert secrets.redact(df).columns == df.columns and secrets.redact(df).count() == df.count()
    assert out[13] == "[SECRET]' [SECRET]" and out[0] is None and out[4] == "two words"
