import random
import re
from collections import Counter, defaultdict

import pytest

from runscope.llm import audit

SCHEMA = "doc_id long, text string, lang string, source string, term string, count int, item int, value string"


def brute(rows, least=3, top=200):
    """The contract, term by term in Python integers."""
    docs = [(t or "", lang or "", source or "") for t, lang, source in rows]
    count, seen, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        count[lang, source].update(terms)
        seen[lang].update(set(terms))
    for lang in {g[0] for g in count}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = sorted(g for g in count if g[0] == lang)
        whole = Counter()
        for g in groups:
            whole.update(count[g])

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + (10**9 * (counts[t] + 1)) // (n + len(kept)) for t in kept}

        p = {g: shares(count[g]) for g in groups}
        q = shares(whole)
        for g in groups:
            pairs = [(sum((p[g][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o[1]) for o in groups if o != g]
            terms = [((p[g][t] - q[t]) ** 2 // q[t], t) for t in kept if count[g][t] and p[g][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def found_by(spark, area, rows, **options):
    made = spark.createDataFrame([(i, t, lang, s, "x", 1, 2, "y") for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in audit.audit_sources(made, area, **options).collect())


def some_rows(n, seed):
    rng = random.Random(seed)
    words = ["The", "the", "é", "É", "漢字", "x1y", "don't", "A", "b\x00c", "<p>", "z_z", "q" * 3000] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(n):
        size = rng.choice([0, 1, 5, 60])
        source = rng.choice(["web", "web", "web", "books", "code", None, "", "é"])
        rows.append((rng.choice([" ", "\n", "\xa0", ", "]).join(rng.choice(words) for _ in range(size)), rng.choice(["en", "fr", None]), source))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, own_area, seed):
    rows = some_rows(120, seed) + [(None, "en", "silent"), ("", "de", "only"), (None, None, None), ("lonely words", "xx", "a"), ("", "xx", "b")]
    rows += rows[:10]
    assert found_by(spark, own_area, rows) == brute(rows)
    assert found_by(spark, own_area, rows, least_docs=1, top=2) == brute(rows, 1, 2)


def test_tasks_that_send_often_count_the_same(spark):
    rows = [(t or "", lang or "", source or "") for t, lang, source in some_rows(60, 3)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    often, once = (sorted(tuple(r) for r in audit.count_terms(docs, held).collect()) for held in (5, 10**6))
    assert often == once and len(once) > 50


def test_empty_table(spark, own_area):
    assert found_by(spark, own_area, []) == []


def test_shares_of_huge_counts_are_exact(spark):
    made = spark.createDataFrame([(10**18, 3 * 10**18, 10**12)], "c long, n long, v long")
    assert made.select(audit.share("c", "n", "v")).first()[0] == 1 + (10**9 * (10**18 + 1)) // (3 * 10**18 + 10**12)


def test_terms_of():
    assert audit.terms_of("Ab aB 1É_É漢".encode()) == {b"ab": 2, "É".encode(): 1, "É漢".encode(): 1}
