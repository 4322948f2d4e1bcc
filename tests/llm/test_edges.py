"""Nulls in every column, repeated rows, empty tables, very long texts, clashing names; verdicts of the rules by brute force."""

import math
import random
from collections import Counter, defaultdict

import brute
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keelson.llm import byte_bpe, near_dedup, pii, quality_classifier, quality_rules, secret_scan, source_mix, suffix_dedup, token_counts

PATH, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
CLASHES = ("_k", "_t", "_n", "_h", "_row", "k", "h", "s", "row", "node", "class", "key", "text_hash", "kept", "positions", "copies", "terms", "email", "told", "lang0", "fences", "known", "place", "blob", "gone", "units")
RND = random.Random(6)
LONG = " ".join(f"word{RND.randint(0, 9000)}" for _ in range(90)) + " bob@corp.example password=abcdefgh1"
ROWS = [(1, LONG, "en", "a"), (1, LONG, "en", "a"), (None, LONG, None, None), (2, LONG + " more", "en", "a"), (None, None, None, None), (None, None, None, None), (3, "", "de", "b"), (3, None, "de", "b"), (4, LONG[::-1], "de", None), (1, LONG[5:], "en", "b")]
BIG = "-eyJaaaaaaaaaa" * 20_000 + " " + "x" * 200_000 + " " + " ".join(str(n) for n in range(40_000))


def _ledger(docs):
    return secret_scan.scan(docs, secret_scan.new_ledger(docs.sparkSession))


def _scored(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    return quality_classifier.score(docs, quality_classifier.fit(docs, labels))


#: One row out for each row in.
EACH = {
    "byte_bpe": lambda d: byte_bpe.round_trip(d, PATH, P.PATTERN),
    "token_counts": lambda d: token_counts.count_tokens(d, WORDS),
    "secret_scan": _ledger,
    "quality_classifier": _scored,
    "source_mix": source_mix.plan,
    "pii": pii.detect,
    "sanitise": pii.sanitise,
    "suffix_dedup": suffix_dedup.dedup,
    "quality_rules": quality_rules.judge,
    "near_dedup": near_dedup.classes,
}
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def messy(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    return docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.mark.parametrize("name", EACH)
def test_messy_rows_and_no_rows(messy, name):
    found = EACH[name](messy)
    ids = Counter(r[0] for r in found.select("doc_id").collect())
    assert ids == Counter(r[0] for r in ROWS)
    assert EACH[name](messy.limit(0)).count() == 0
    if name == "sanitise":
        assert found.columns == messy.columns
        for r in found.collect():
            assert all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHES) and "bob@" not in (r["text"] or "")


def test_what_messy_rows_give(messy):
    by = lambda df, *c: Counter(tuple(r) for r in df.select("doc_id", *c).collect())
    assert by(EACH["secret_scan"](messy), "n_assign", "n_access", "n_hex") == Counter((i, *brute.secrets(t)[:3]) for i, t, _, _ in ROWS)
    assert by(EACH["quality_rules"](messy), *quality_rules.MEASURES, "base_failed") == Counter((i, *brute.rules(t)) for i, t, _, _ in ROWS)
    classes = {(r["doc_id"], r["class_id"]) for r in near_dedup.classes(messy).where("copies_in_class > 1").collect()}
    assert classes == {(1, 1), (None, 1), (2, 1)}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_whatever_they_are_called(spark, messy, name):
    stage, last = STAGES[name], name == "byte bpe"
    found = stage(spark, messy, "")
    rows = found.collect()
    if not last:
        assert set(messy.columns) <= set(found.columns) <= {*messy.columns, "position"}
        assert rows and all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHES)
    assert len(rows) == {"quality rules": len([1 for r in ROWS if not brute.rules(r[1])[5]]), "near dedup": 4, "personal data": len(ROWS), "byte bpe": len(ROWS)}.get(name, len(rows))
    assert stage(spark, messy.limit(0), "").count() == 0


def test_a_very_long_text(spark):
    big = spark.createDataFrame([(1, BIG, "en", "a"), (2, BIG, "en", "a"), (3, "short", "en", "a")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"]) for r in EACH["secret_scan"](big).collect()}[1] == brute.secrets(BIG)[:3]
    assert {tuple(r) for r in near_dedup.classes(big).select("doc_id", "class_id").collect()} == {(1, 1), (2, 1), (3, 3)}
    left = {r["doc_id"]: (r["n_removed"], r["n_bytes"]) for r in suffix_dedup.dedup(big).collect()}
    assert left[2] == (len(BIG), len(BIG)) and 0 < left[1][0] < len(BIG)
    done = {r["doc_id"]: bytes(r["decoded"]) for r in EACH["byte_bpe"](big).collect()}
    assert done[1] == BIG.encode()
    assert {r["doc_id"]: r["n_words"] for r in EACH["quality_rules"](big).collect()}[1] == len(brute.WORD.findall(BIG))


def test_many_matches_stay_linear(spark):
    from time import perf_counter

    took = []
    for n in (300_000, 3_000_000):
        docs = spark.createDataFrame([(1, "-eyJaaaaaaaaaa" * (n // 14))], "doc_id long, text string").repartition(1)
        began = perf_counter()
        docs.select(secret_scan.find_spans(F.col("text"))).collect()
        took.append(perf_counter() - began)
    assert took[1] < 25 * max(took[0], 1)


def test_a_second_scan_finds_nothing_unseen(spark, messy, monkeypatch):
    ledger, scanned = secret_scan.new_ledger(spark), []
    scan = secret_scan.scan_blobs
    monkeypatch.setattr(secret_scan, "scan_blobs", lambda blobs, version: (scanned.append(blobs.count()), scan(blobs, version))[1])
    first = Counter(map(tuple, secret_scan.scan(messy, ledger).collect()))
    more = messy.unionByName(messy.limit(1).withColumn("text", F.lit("a new version token=abcdefgh9")))
    assert Counter(map(tuple, secret_scan.scan(messy, ledger).collect())) == first
    secret_scan.scan(more, ledger)
    assert scanned == [len({r[1] or "" for r in ROWS}), 0, 1]


def _fences(rows):
    """Verdicts from sorted values: quartiles by log bucket, drawn to wider groups, far-out fences."""
    measured = {}
    for i, t, lang, source in rows:
        n, chars, symbols, dup, repeat, failed = brute.rules(t)
        lines = len([x for x in t.split("\n") if brute.WORD.search(x)])
        measured[i] = (lang, source, failed, {"mean_word_chars": chars / max(n, 1), "symbols_per_word": symbols / max(n, 1), "dup_line_share": dup / max(lines, 1), "repeat_share": repeat / max(n, 1)})
    groups = defaultdict(list)
    for lang, source, failed, m in measured.values():
        if not failed:
            for g in ((lang, source), lang, "all of them"):
                groups[g].append(m)

    def quartile(group, k, q):
        bucket = sorted(-(10**6) if m[k] <= 0 else math.ceil(math.log(m[k]) / math.log(1.02)) for m in groups[group])
        at = next(b for c, b in enumerate(bucket, 1) if c >= q * len(bucket))
        return 0.0 if at == -(10**6) else 2 * 1.02**at / 2.02

    def drawn(lang, source, k, q):
        wide = (len(groups[lang]) * quartile(lang, k, q) + 50 * quartile("all of them", k, q)) / (len(groups[lang]) + 50)
        n = len(groups[lang, source])
        return (n * quartile((lang, source), k, q) + 50 * wide) / (n + 50) if n else wide

    out = {}
    for i, (lang, source, failed, m) in measured.items():
        bad = failed
        for k, least, below in (("mean_word_chars", 2.0, True), ("symbols_per_word", 0.15, False), ("dup_line_share", 0.3, False), ("repeat_share", 0.25, False)):
            if not failed:
                q1, q3 = drawn(lang, source, k, 0.25), drawn(lang, source, k, 0.75)
                reach = max(3 * (q3 - q1), least)
                bad |= m[k] > q3 + reach or below and m[k] < q1 - reach
        out[i] = not bad
    return out


def test_verdicts_are_those_of_the_fences(spark):
    rnd, rows = random.Random(12), []
    for lang, source, n, wide in (("en", "a", 70, 5), ("en", "b", 60, 9), ("de", "a", 55, 7), ("de", None, 4, 7), ("xx", "c", 1, 5)):
        for _ in range(n):
            odd = rnd.random() < 0.15
            words = ["".join(rnd.choice("abcdefgh") for _ in range(max(1, int(rnd.gauss(wide, 1)) * (3 if odd and rnd.random() < 0.4 else 1)))) for _ in range(rnd.randint(50, 90))]
            marks = " $$" * (rnd.randint(10, 40) if odd else rnd.randint(0, 3))
            lines = ("\nthe same line" * rnd.randint(4, 30)) if odd else ""
            rows.append((len(rows), " ".join(words) + marks + lines, lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    want = _fences(rows)
    assert got == want and 5 < sum(not x for x in want.values()) < 100
    assert {r["doc_id"] for r in quality_rules.keep_good(docs).collect()} == {i for i, x in want.items() if x}


def test_generalised_terms_are_wide_classes(spark):
    rows = [(n, f"words contact numb{chr(97 + n % 20)}er other") for n in range(200)] + [(200, "words contact Wordsworthian quagga ann@corp.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    # "word..." holds "words" of all texts, so it tells nothing; no other word begins as the second does.
    assert clean[200] == "words contact [word*] [TERM] [EMAIL]" and clean[0] == rows[0][1]


def test_terms_are_found_in_any_case(spark):
    words = ["İstanbulite", "Straße", "ΟΔΟΣΣ", "kelvinſ", "Zürcherin"]
    rows = [(n, f"words contact number{n} other") for n in range(300)] + [(300 + n, f"words {w} {w.lower()} {w}x contact a{n}@corp.example") for n, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [rows[r["doc_id"]][1][s["start"] : s["end"]] for s in r["terms"]] for r in pii.detect(docs).collect()}
    for n, w in enumerate(words):
        assert {w, f"{w}x"} <= set(found[300 + n]) | ({f"{w}x"} if w[0] == "İ" else set()), (w, found[300 + n])
    assert not any(found[n] for n in range(300))
