"""Quality, secrets, sentencepiece and language id on odd rows and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import langid, quality, secrets, text
from blockloom.llm import sentencepieces as sp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def windows(words, n):
    c = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return {k for i in range(len(words) - n + 1) if c[tuple(words[i : i + n])] > 1 for k in range(i, i + n)}


def brute_quality(s):
    s = s or ""
    w = WORD.findall(s)
    seen, dup, dup_chars = set(), 0, 0
    for line in s.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    out = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), dup, len(windows(w, 3)), dup_chars]
    return out + [sum(len(w[k]) for k in windows(w, n)) for n, _ in quality.COVERAGE]


def test_quality_against_brute_force(spark, odd, sf):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    names = [n for n, _ in quality.FIELDS]
    rows = quality.quality(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = brute_quality(r["text"])
        assert [r[n] for n in names] == want
        base = want[0] < 50 or 100 * want[4] > 50 * want[0]
        bad = [n for (n, most), v in zip(quality.COVERAGE, want[6:]) if v > most * want[1]]
        assert r["base_failed"] == base and r["kept"] == (not base and not bad and want[5] <= quality.MAX_LINE_SHARE * want[1])


def test_quality_lines_without_end():
    raw = np.frombuffer(b"a\na\n\nb\na", np.uint8)
    off = np.array([0, 2, 3, 3, len(raw)])  # "a\n", "a", "", "\n\nb\na"
    assert quality.measure(raw, off)[3].tolist() == [0, 0, 0, 0]


def test_quality_lines_of_texts_that_begin_with_newlines():
    texts = ["ab", "\nxy zz\nxy zz", "", "\n\nq\nq\n", "\n", "q"]
    rng = random.Random(6)
    texts += ["".join(rng.choice("\n\nab ") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    got = np.stack(quality.measure(raw, off), 1).tolist()
    assert got[1][3] == got[3][3] == 1
    assert got == [brute_quality(t) for t in texts]


def test_empty_and_clashing(spark, none, odd):
    assert quality.quality(none).count() == 0 and secrets.secrets(none).count() == 0 and sp.pieces(none, MODEL).count() == 0
    clash = odd.withColumns({"kept": F.lit("x"), "spans": F.lit(1), "ids": F.lit("i"), "lang_pred": F.lit(0), "n_words": F.lit("w"), "a b": F.lit(1)})
    assert quality.quality(clash).schema["kept"].dataType.simpleString() == "boolean"
    assert secrets.secrets(clash).schema["spans"].dataType.simpleString() == "string"
    assert sp.pieces(clash, MODEL).first()["a b"] == 1
    assert langid.predict(clash, None).schema["lang_pred"].dataType.simpleString() == "string"


def brute_spans(s):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(s) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", s) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", s) if len(m[0]) >= 16])


def test_secret_base_spans():
    rng = random.Random(4)
    bits = ["password", "PassWd", "token", "api_key", "ApiKey", "secret", "ſecret", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "x", "é", "😀", "abcdefghijkl", ".", "\n"]
    for _ in range(4000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(s, s.lower()) == brute_spans(s), s
        assert [x for x in secrets.scan(s) if x[1] < 3] == brute_spans(s)


def test_novel_spans_and_redaction():
    s = "The credential is Zx9kQ2mV7pLw3RtY8uBn5cD1 for you, and authorization example_configuration_default_value1 too"
    found = secrets.scan(s)
    assert [(s[a:b], secrets.KINDS[k]) for a, k, b in found] == [("Zx9kQ2mV7pLw3RtY8uBn5cD1", "novel")]
    assert secrets.redacted(s, found) == s.replace("Zx9kQ2mV7pLw3RtY8uBn5cD1", "[REDACTED]")
    again = "auth Zx9kQ2mV7pLw3RtY8uBn5cD1 Zx9kQ2mV7pLw3RtY8uBn5cD1"  # seen nearby, so not novel
    assert not secrets.scan(again)
    assert secrets.scan(None) == [] and secrets.redacted(None, []) is None
    spans = [(0, 0, 5), (3, 2, 9), (9, 1, 10)]
    assert secrets.redacted("0123456789ab", spans, "#") == "##ab"


@pytest.mark.parametrize("name", ["access_key", "private_key", "passphrase", "credential", "credentials", "Signature", "SECRET_KEY", "AWS_SECRET_ACCESS_KEY", "auth session"])
def test_novel_values_directly_after_an_assignment(name):
    value = "Zx9kQ2mV7pLw3RtY8uBn5cD1fH6jS4gK0aEqWvXo"
    for v, end in ((value, " now"), (value + "==", ";"), (value, ""), (value[:16], "\n")):
        s = f"set {name}={v}{end}"
        assert [(s[a:b], secrets.KINDS[k]) for a, k, b in secrets.scan(s)] == [(v, "novel")], s
    joined = "credential Zx9kQ2mV7p=Lw3RtY8uBn"  # the parts are too short, the run is not
    assert [joined[a:b] for a, _, b in secrets.scan(joined)] == ["Zx9kQ2mV7p=Lw3RtY8uBn"]
    assert not secrets.scan(f"set {name}=example_configuration_default_value1 ")


@pytest.mark.parametrize("alphabet", ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789"])
def test_novel_spans_of_any_length(alphabet):
    rng = random.Random(9)
    for n in (40, 48, 49, 63, 64, 80, 128, 256, 300, 1000, 5000):
        for _ in range(10):
            value = "".join(rng.choice(alphabet) for _ in range(n - 2)) + alphabet[-1] + "7"
            s = f"the bearer sent {value} and went on with the rest of the words"
            assert [s[a:b] for a, k, b in secrets.scan(s) if k == 3] == [value]
    for word in ("example_configuration_default_value1_", "wxyz1234", "production/development/staging/localhost1/"):
        s = "the bearer sent " + word * 40
        assert not secrets.scan(s), s
    some = "".join(rng.choice("GHIJKLMNOPQRSTUVWXYZ") for _ in range(40))
    s = f"the bearer sent {some}0123456789012345 and {some[:10]}0123456789012345"
    assert secrets.scan(s) == [(16, 3, 72), (56, 2, 72), (87, 2, 103)]  # a base span inside does not hide the rest


def test_secrets_digest(odd):
    for r in secrets.secrets(odd).collect():
        spans = brute_spans(r["text"] or "")
        text_ = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text_.encode()).hexdigest() and r["n_assign"] == sum(k == 0 for _, k, _ in spans)


def test_sentencepiece_equals_the_library():
    enc = sp.Encoder(MODEL)
    rng = random.Random(1)
    bits = " \n▁ab\t0é日𝒳ﬁ\0thes.,²'()<s>—"
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 2000, "\n" * 50, "aab" * 500, "▁" * 7 + " x", "", None, "x".join("ab" for _ in range(40))]
    own = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert own == enc.sp.encode([t or "" for t in texts], add_bos=True, add_eos=True)
    for s in ("abcthe" * 20, "é日" * 30):
        one, count = enc.rows([s[:30]])
        assert one.tolist() == enc.heap(s[:30]) and count.tolist() == [len(one)]


def test_sentencepiece_rows(odd):
    enc = sp.Encoder(MODEL)
    for r in sp.pieces(odd, MODEL).collect():
        ids = enc.sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == enc.sp.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_sentencepiece_cache_can_overflow(monkeypatch):
    monkeypatch.setattr(sp, "CACHE", 50)
    enc = sp.Encoder(MODEL)
    texts = [" ".join(f"w{i}{j}" for i in range(30)) for j in range(10)]
    for part in (texts[:5], texts[5:], texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(part)] == enc.sp.encode(part, add_bos=True, add_eos=True)


def test_language_id_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(~langid.held_out()).select("lang", "text"))
    rows = langid.predict(docs, model).withColumn("h", langid.held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["h"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_sample_counts_copies_once(spark):
    rows = [("en", f"text {c}") for c in "abcdefghij" for _ in range(400)] + [("de", f"wort {i}") for i in range(30)] + [("fr", f"mot {i}") for i in range(5)]
    got = Counter((r["lang"], r["text"]) for r in langid.sample(spark.createDataFrame(rows, "lang string, text string"), 60).collect())
    assert max(got.values()) == 1
    n = Counter(lang for lang, _ in got)
    assert n["en"] == 10 and n["fr"] == 5 and 8 < n["de"] <= 20
    many = [(f"l{i:03}", "a b") for i in range(50)] + [("zz", f"c {i}") for i in range(9)]
    got = langid.sample(spark.createDataFrame(many, "lang string, text string").repartition(4), 3).collect()
    assert {r["lang"] for r in got} <= {"zz", "l000", "l001"}


def test_language_id_odd_rows(odd, none):
    model = langid.learn(odd.select("lang", "text"))
    for r in langid.predict(odd, model).collect():
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letter) and (letter or r["score"] == 0)
    assert langid.learn(none.select("lang", "text")) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 90])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n
    if n > 5:
        far = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert far > code.shape[1] // 5


def test_words_and_slices():
    texts = pa.array(["a b", None, "", "c" * 50, " d\x0be "])
    got = [(a, b, len(raw)) for a, b, raw, _ in text.slices(texts, 10)]
    assert got == [(0, 3, 3), (3, 4, 50), (4, 5, 5)]
    raw = np.frombuffer(b"ab cdef", np.uint8)
    starts, ends, first = text.bounds(raw, np.array([0, 4, 4, 7]))
    assert starts.tolist() == [0, 3, 4] and ends.tolist() == [2, 4, 7] and first.tolist() == [0, 2, 2, 3]
