import hashlib
import random
import re
import string

import numpy as np
import pytest

from octaspark.llm import secrets
from tests.llm.conftest import ODD

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    """Base places of a text, found the plain way."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def check(rows, got):
    assert len(rows) == len(got)
    by_id = sorted(got, key=lambda r: repr((r.doc_id, r.base_sha256)))
    want = sorted(((i, base(t)) for i, t in rows), key=lambda r: repr((r[0], hashlib.sha256(",".join(r[1]).encode()).hexdigest())))
    for r, (i, places) in zip(by_id, want):
        assert r.doc_id == i and r.base_sha256 == hashlib.sha256(",".join(places).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(p.startswith(k) for p in places) for k in ("assign", "access", "hex")]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("model")] == places and len(spans) - len(places) == r.n_model


@pytest.fixture(scope="module")
def model():
    return secrets.train()


def test_base_findings_of_all_documents(spark, sf, texts, model):
    got = secrets.digest(secrets.scan(spark.read.parquet(f"{sf}/documents.parquet"), model)).collect()
    check(list(texts.items()), got)


def test_odd_rows(spark, make_docs, model):
    rows = [
        *ODD, (30, "Token:abcdef TOKEN = 'xy' secret=token=abcdef secret=token:abcdefgh api_key: \"a.b.c-d_e\" APIKEY=====1 passwd='" + "z" * 50_000),
        (31, "AKIA" + "A" * 15 + " AKIA" + "Z9" * 8 + " " + "0123456789abcdef" * 4000), (31, "é" * 30 + "tokeN=" + "f" * 30), (32, "tokenſ=abcdefgh toKen=abcdefgh"),
        (33, "A1b2" * 20_000), (None, "password: hunter22"), (34, "\0" * 40 + "token=\0abcdefg" + "\0"),
    ]
    got = secrets.digest(secrets.scan(make_docs(rows, extra=["findings", "kind", "spans"]), model)).collect()
    check(rows, got)
    assert secrets.digest(secrets.scan(make_docs(rows).limit(0), model)).count() == 0


def test_pooling_equals_plain_loops(model, monkeypatch):
    found = [("ab = Zk9_/+ é!", 5, 11), ("x" * 200, 60, 190), ("q", 0, 1)]
    codes, edges = secrets.encode(found)
    half = secrets.TAPS // 2
    at = lambda t: int(codes[t]) if 0 <= t < len(codes) else 0
    plain = [np.maximum(0, model.bias + sum(model.kernel[j, at(t + j - half)] for j in range(secrets.TAPS))) for t in range(len(codes))]
    want = []
    for k in range(len(found)):
        a, b, c, d = edges[3 * k : 3 * k + 4]
        want.append(np.concatenate([np.max(plain[a:b], 0), np.max(plain[b:c], 0), np.max(plain[c:d], 0), np.mean(plain[b:c], 0)]))
    for block in (1 << 16, 7):  # a long candidate is read in blocks
        monkeypatch.setattr(secrets, "BLOCK", block)
        np.testing.assert_allclose(model.pooled(codes, edges), np.array(want), rtol=1e-4, atol=1e-5)


def test_gradients_lower_the_loss():
    rows = secrets.labelled_findings(4, 200)
    y = np.array([r[3] for r in rows])

    def loss(m):
        p = 1 / (1 + np.exp(-np.clip(m.logits([r[:3] for r in rows]), -30, 30)))
        return -np.mean(np.log(np.where(y == 1, p, 1 - p) + 1e-9))

    assert loss(secrets.fit(rows, epochs=15)) < 0.3 * loss(secrets.fit(rows, epochs=0))


def test_threshold_keeps_the_recall_and_scores_are_calibrated(model):
    rows = secrets.labelled_findings(77, 1500)
    s, y = model.scores([r[:3] for r in rows]), np.array([r[3] for r in rows])
    found = np.array([x >= model.threshold(t[a:b]) for x, (t, a, b, _) in zip(s, rows)])
    assert found[y == 1].mean() > secrets.RECALL - 0.04 and y[found].mean() > 0.85
    for lo, hi in ((0, 0.2), (0.8, 1.01)):
        part = (s >= lo) & (s < hi)
        assert abs(s[part].mean() - y[part].mean()) < 0.08


def test_lines_not_made_by_the_rule(model):
    """Keys and harmless tokens written down by hand; random parts are drawn here."""
    rng = random.Random(3)
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    bad = [
        f"curl -H 'Authorization: Bearer {key(40)}' https://example.org/v1/me", f"AWS_SECRET_ACCESS_KEY={key(20)}/{key(19)}", f"export GH=ghp_{key(36)}", f"stripe.key = sk_live_{key(24)}",
        f'"client_credential": "{key(32)}",', f"SLACK=xoxb-{key(12)}-{key(24)}", f"db_pwd={key(22)}", f"AccountKey={key(86)}==;EndpointSuffix=core", f"signature: {key(43)}=", f"license {key(28)}",
    ]
    fine = [
        "The thermodynamically unfavourable counterrevolutionaries left.", "see src/main/java/org/example/config/ApplicationContext.java line 7", "AbstractSingletonProxyFactoryBean is a class name",
        "my_really_long_variable_name_for_tests = 3", "card 4111111111111111 was declined", "==============================", "https.example.org/blog/2021/07/how-we-build-things.html",
        "Donaudampfschifffahrtsgesellschaft fuhr ab.", "INTERNATIONALIZATION MATTERS", "released on 2021-11-30T10.15.30 in Lyon",
    ]
    hit = lambda lines: sum(bool(f) for f in secrets.findings(lines, model))
    assert hit(bad) >= 8 and hit(fine) <= 1
