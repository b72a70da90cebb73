"""Operators that judge every row by itself, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import licenses, pii, ppm, quality, secrets
from latticework.llm.queries import LLM_QUERIES
from latticework.llm.queries import _base

from .brute import WORD, lower_ascii, words
from .conftest import LONG, ROWS


def test_quality_statistics_match_plain_python(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 1), (9, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.assess(odd, labels)
    assert got.columns == ["doc_id", "text", "source", "size", "shard", "score", "row", "n_words", "word_chars", "n_symbols",
                           "n_dup_lines", "n_repeat_words", "log_ratio", "base_failed", "kept"]
    seen = Counter()
    for r in got.collect():
        t, w = r.text or "", words(r.text, False)
        windows = Counter(tuple(w[k: k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if windows[tuple(w[k: k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        seen[r.doc_id] += 1
    assert seen == Counter(r[0] for r in ROWS)


def test_quality_ratio_is_the_log_of_two_multinomials(spark):
    docs = spark.createDataFrame([(i, f"good plain words here number {i} and some more good words") for i in range(20)]
                                 + [(100 + i, "zq### xv$$$ " * 10) for i in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.assess(docs, labels, threshold=-0.15).collect()}
    assert all(got[i].kept for i in range(20)) and not any(got[100 + i].kept for i in range(5))
    ratios = quality.log_ratios(docs, quality.trusted_ids(labels))
    grams = docs.where("doc_id = 3").select(quality.let(quality.word_hashes(F.col("text")), quality.grams)).first()[0]
    assert got[3].log_ratio == pytest.approx(sum(ratios[b] for b in grams) / len(grams))
    bare = quality.assess(docs, labels.where("false")).agg(F.min("log_ratio"), F.max("log_ratio")).first()
    assert tuple(bare) == (0.0, 0.0)
    assert quality.assess(docs.where("false"), labels).count() == 0


SECRETS = [
    "token = secret = abcdef", "API_KEY: 'abc12'  apikey='abcdef' Password  :  \"x/y+z_=-.\" x", "AKIA" + "A1" * 8, "AKIA" + "A" * 15,
    "0" * 23 + " " + "deadbeef" * 3 + "g" + "f" * 24, "tokentoken: 1234567890abcdef1234567890abcdef", "secret=" + "a" * 5000,
    "ghp_" + "a" * 36 + ", xoxb-1234567890-abc", "é secret: ünder password=übercool passwd:geheim123é", "-----BEGIN RSA PRIVATE KEY-----",
    "token token:=abcdefg", "secret\n=abcdefgh", "AKIAAKIA" + "B" * 14, "api-key=abcdefg", None, "",
]


def test_secret_spans_match_the_expressions(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(SECRETS)], "doc_id long, text string, spans string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_secrets(docs).collect()}
    kinds = list(secrets.RULES)
    for i, t in enumerate(SECRETS):
        want = []
        for k, (rule, what, least) in secrets.RULES.items():
            want += [(m.start(), kinds.index(k), m.end()) for m in re.finditer(rule, t or "")
                     if len(m[1] if what == "value" else m[0]) >= least]
        assert got[i] == [(kinds[k], a, b) for a, k, b in sorted(want)], t
    assert sum(map(len, got.values())) > 12


def _expected_spans(text):
    kinds, want = list(secrets.RULES), []
    for k, (rule, what, least) in secrets.RULES.items():
        want += [(m.start(), kinds.index(k), m.end()) for m in re.finditer(rule, text) if len(m[1] if what == "value" else m[0]) >= least]
    return sorted(want)


def test_spans_of_random_texts_are_those_of_the_expressions():
    rng = np.random.default_rng(3)
    parts = ["token", "secret", "Password", "=", " ", "AKIA", "x", "deadbeef", "9", ":", "\"", "'", "ghp_", "eyJ", "eyJa", ".", "xoxp-", ",", "-----BEGIN ",
             "PRIVATE KEY-----", "RSA ", "_", "/", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "sk_live_", "AIza", "\n"]
    found = 0
    for _ in range(150):
        texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(20)]
        raw = "".join(texts).encode()
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = [[] for _ in texts]
        for d, a, r, b in secrets._spans(np.frombuffer(raw, np.uint8), offsets, secrets.automaton()):
            got[d].append((a - int(offsets[d]), r, b - int(offsets[d])))
        for t, g in zip(texts, got):
            assert g == _expected_spans(t), t
            found += len(g)
    assert found > 500


def test_query_of_secrets(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*SECRETS, "token=secret:password=abcdefg", "eyJa.eyJb.c.d" * 9, "ghp_abcghp_" + "x" * 40])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in LLM_QUERIES["op7_secret_scans"](spark, str(tmp_path)).collect()}
    kinds = list(secrets.RULES)
    for i, t in rows:
        want = [(kinds[k], a, b) for a, k, b in _expected_spans(t or "")]
        r = got[i]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r[f"n_{k}"] for k in secrets.BASE] == [sum(w[0] == k for w in want) for k in secrets.BASE]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in want if k in secrets.BASE)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_odd_rows_have_no_secrets_and_keep_their_columns(odd, none):
    got = secrets.find_secrets(odd)
    assert got.columns == [*odd.columns, "spans"] and got.count() == len(ROWS) and got.where("size(spans) > 0").count() == 0
    assert secrets.find_secrets(none).count() == 0 and pii.find_personal_data(none).count() == 0


PERSONAL = [
    "mail a.b+c@x-y.org, then @ and x@y and q@r.s.t.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 999", "4111 1111 1111 1111 and 4111111111111112",
    "+1 (499) 555-6503 and +12 and +1 2345678 ()", "éé 5500-0000-0000-0004 ", "a@b@c.d.e x@@y.z", "1.2.3.4@host.de", None, "",
    "9" * 4000, "x" * 5000 + "@", "+" + "1" * 15 + " " + "+" + "1" * 16,
]


def _personal(text):
    spans = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            spans.append((2, *m.span()))
    return spans + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                    if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_personal_rules_match_the_expressions(spark):
    for t in PERSONAL:
        if t and len(t) < 4000:
            assert pii.rule_spans(t) == sorted(_personal(t)), t
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PERSONAL)], "doc_id long, text string")
    got = pii.find_personal_data(docs).withColumn("base", F.filter("spans", lambda s: s["rule"])).select(
        "doc_id", "spans", _base(pii.KINDS)).collect()
    for r in got:
        want = [(pii.KINDS[k], a, b) for k, a, b in sorted(_personal(PERSONAL[r.doc_id] or ""))]
        assert [(s.kind, s.start, s.end) for s in r.spans if s.rule] == want
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_tagger_on_held_out_windows():
    model = pii.trained()
    ids, tags = pii.training_windows(np.random.default_rng(77), 300, 60_000, 9)
    found, _ = model.decode(ids)
    assert (found == tags).mean() > 0.97
    assert (found[tags > 0] == tags[tags > 0]).mean() > 0.9
    assert (found[tags == 0] > 0).mean() < 0.01


def test_tagger_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = pii.BiLstmCrf(rng)
    ids, tags = (x[:, :12] for x in pii.training_windows(rng, 5))

    def loss():
        e = model.emissions(ids)
        _, alpha, _, norm = model._posteriors(e)
        n, steps = tags.shape
        gold = model.p["first"][tags[:, 0]] + e[0][np.arange(n), tags[:, 0]]
        for t in range(1, steps):
            gold = gold + model.p["move"][tags[:, t - 1], tags[:, t]] + e[t][np.arange(n), tags[:, t]]
        return float((norm - gold).mean())

    slopes = model.gradients(ids, tags)
    for name, at in (("out", (3, 2)), ("move", (0, 1)), ("hf", (2, 9)), ("xb", (1, 20)), ("bf", (7,)), ("first", (0,))):
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        down = loss()
        model.p[name][at] += 1e-5
        assert slopes[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_tagger_joins_windows_over_a_long_text():
    filler = "plain words without any marks " * 40
    text = filler + "call (499) 555-6503 now " + filler + "mail bob @ post.example . org " + filler
    found = pii.model_spans([text, "", "no digits"], pii.trained())
    assert found[1] == found[2] == []
    assert any(text[a:b].startswith("(499") or text[a:b].startswith("499") for k, a, b in found[0] if k == 3)


def test_tagger_follows_spans_into_windows_without_marks(monkeypatch):
    filler = "plain words without any marks " * 10
    long_ = ["jane @ university-hospital . example . org", "margaret.thatcher.jones @ post . example . org"]
    texts = [filler + "x" * k + " mail " + address + " now " + filler for address in long_ for k in range(32)]
    got = pii.model_spans(texts, pii.trained())
    monkeypatch.setattr(pii, "_windows", lambda ids: list(range(0, len(ids), pii.STEP)))
    whole = pii.model_spans(texts, pii.trained())
    assert got == whole and any(whole)


def test_licences_are_named_and_plain_text_is_not(spark, odd, none):
    texts = ["some words here\nReleased under the MIT License.", licenses.TEMPLATES["apache"][1], "He lost his driving license.",
             "intro\n\n" + licenses.TEMPLATES["gpl"][0] + "\nend", None, "", "Licensed under CC BY-NC 4.0.", LONG]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].licence for i in range(8)] == ["mit", "apache", "unknown", "gpl", "unknown", "unknown", "cc", "unknown"]
    assert got[3].n_paragraphs == 3 and [p.paragraph for p in got[3].licences] == [1]
    assert licenses.scan(odd).count() == len(ROWS) and licenses.scan(none).count() == 0


def test_lm_base_and_score_match_plain_python(odd, none):
    got = ppm.lm_scores(odd, keep=["doc_id", "text", "score"]).collect()
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1
    counts, grams = Counter(), Counter()
    for i, t, _ in ROWS:
        if not held(i):
            counts.update([*words(t), "\0end"])
            b = b"\0" * 5 + lower_ascii(t or "").encode() + b"\0"
            grams.update(b[k - 5: k + 1] for k in range(5, len(b)))
    total, kinds = sum(counts.values()), len(counts)

    def table(order):
        out = {}
        for g, n in grams.items():
            out.setdefault(g[5 - order: 5], Counter())[g[5]] += n
        return out

    tables = {k: table(k) for k in (5, 3, 2, 1, 0)}

    def probability(context, symbol):
        out, barred = 1.0, set()
        for order in (5, 3, 2, 1, 0):
            seen = {s: n for s, n in tables[order].get(context[5 - order:], {}).items() if s not in barred}
            if not seen:
                continue
            size = sum(seen.values()) + len(seen)
            if symbol in seen:
                return out * seen[symbol] / size
            out *= len(seen) / size
            barred |= set(seen)
        return out / (256 - len(barred))

    assert len(got) == len(ROWS)
    for r in got:
        w = [*words(r.text), "\0end"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (
            len(w), sum(x in counts for x in w), total, held(r.doc_id))
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w))
        if len(w) < 100:
            b = b"\0" * 5 + lower_ascii(r.text or "").encode() + b"\0"
            want = sum(math.log10(probability(b[k - 5: k], b[k])) for k in range(5, len(b)))
            assert r.score == pytest.approx(want, rel=1e-4)
    assert ppm.lm_scores(none).count() == 0


def test_model_rows_are_distributions():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 103, 4000).astype(np.uint32)
    g4 = (text[:-3] << 24) | (text[1:-2] << 16) | (text[2:-1] << 8) | text[3:]
    key4, n4 = np.unique(g4, return_counts=True)
    key3, back = np.unique(key4 & np.uint32(0xFFFFFF), return_inverse=True)
    model = ppm.PpmModel(key4, n4, key3, np.bincount(back, weights=n4))
    assert np.allclose((10.0 ** model.table.astype(np.float64)).sum(axis=1), 1, atol=1e-3)


@pytest.mark.parametrize("caps", [(4, 1 << 21), (1 << 15, 40), (4, 40), (0, 0)])
def test_lm_score_does_not_depend_on_the_size_of_its_tables(odd, monkeypatch, caps):
    def scores():
        return sorted((str(r.doc_id), r.text or "", r.score) for r in ppm.lm_scores(odd, keep=["doc_id", "text", "score"]).collect())
    whole = scores()
    monkeypatch.setattr(ppm, "CONTEXTS", caps[0])
    monkeypatch.setattr(ppm, "LISTED", caps[1])
    for got, want in zip(scores(), whole, strict=True):
        assert got[:2] == want[:2] and got[2] == pytest.approx(want[2], rel=1e-5)
