"""Operators over documents and pages against plain versions, with awkward rows."""

import hashlib
import random
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import PROSE, WORD, by_id, documents, near_components, rows

from tidemark.llm import exact_dedup, license_scans, mixing, near_dedup, quality_classifier, quality_rules, url_filters
from tidemark.llm.components import components
from tidemark.llm.license_templates import TEMPLATES


def test_mix_of_odd_rows(spark):
    found = mixing.mix(documents(spark), carry=("doc_id", "source")).select("row.*", "size", "source_size", "target", "taken").collect()
    assert len(found) == len(rows())
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    taken, targets = Counter(), {r.source: r.target for r in found}
    for r in found:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for source, target in targets.items():
        assert target <= 3 * sizes[source] and taken[source] == int(target + 0.5)
    again = mixing.mix(documents(spark).repartition(5), carry=("doc_id", "source")).select("row.*", "size", "taken").collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in found)
    assert mixing.mix(documents(spark, [])).count() == 0


def test_targets_stop_at_the_cap_and_the_excess_is_shared(spark):
    pick = random.Random(1)
    for _ in range(3):
        sizes = {f"s{i}": pick.choice([0, 1, 5, 1000, 40_000]) for i in range(9)}
        frame = spark.createDataFrame([(s, n, 1 + i % 3) for i, (s, n) in enumerate(sorted(sizes.items()))], "source string, source_size long, weight long")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        weights, total = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}, sum(sizes.values())
        want, free = {}, dict(weights)
        while free:  # the rule as it is told
            level = (total - sum(want.values())) / sum(free.values())
            full = [s for s, w in free.items() if level * w > 3 * sizes[s]]
            for s in full:
                want[s] = 3 * sizes[s]
                del free[s]
            if not full:
                want |= {s: level * w for s, w in free.items()}
                break
        assert got == pytest.approx(want)


def test_given_weights_and_whole_documents(spark):
    docs = documents(spark, [(i, "w " * (1 + i % 5), "en", "ab"[i % 2], 1, 0, "x", "x", "x", "x") for i in range(200)])
    weights = spark.createDataFrame([("a", 1), ("b", 3)], "source string, weight int")
    mixed = mixing.mixed_documents(docs, weights)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert words["a"] + words["b"] == pytest.approx(sum(1 + i % 5 for i in range(200)), abs=10)
    assert words["b"] == pytest.approx(3 * words["a"], abs=12)


def test_quality_counts_of_odd_rows(spark):
    found = by_id(quality_rules.judged(documents(spark)))
    for doc_id, text, *_ in rows():
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found[doc_id]]
        assert want in got, (doc_id, want, got)
        for r in found[doc_id]:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality_rules.judged(documents(spark, [])).count() == 0


def test_junk_lies_far_and_short_texts_pass(spark):
    pick = random.Random(2)
    words = "the of and to river stone garden walks slowly under green trees while children play near old house by water".split()
    text = lambda n, end="": " ".join(pick.choice(words) + end for _ in range(n))
    made = [(i, text(80), "en") for i in range(40)] + [(100, text(80, "***"), "en"), (101, text(80).upper(), "en"), (102, " | ".join(text(80).split()), "en"), (103, text(12), "en")]
    made += [(104, text(60), "xx"), (105, text(60), None)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_rules.judged(frame).collect()}
    assert all(kept[i] for i in range(40)) and kept[103] and kept[104] and kept[105]
    assert not any(kept[i] for i in (100, 101, 102))


def test_jensen_shannon(spark):
    pairs = [([1, 2, 3], [1, 2, 3]), ([1, 0], [0, 1]), ([3, 1, 0], [1, 1, 2]), ([0, 0], [1, 1])]
    frame = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    got = [r[0] for r in frame.select(quality_rules.jensen_shannon(frame.a, frame.b)).collect()]
    for (a, b), value in zip(pairs, got):
        if not sum(a):
            assert value is None
            continue
        p, q = np.array(a) / sum(a), np.array(b) / sum(b)
        m = (p + q) / 2
        divergence = sum(0.5 * x * np.log2(x / y) for x, y in zip([*p, *q], [*m, *m]) if x > 0)
        assert value == pytest.approx(divergence**0.5)


def test_classifier_learns_and_handles_odd_rows(spark):
    pick = random.Random(4)
    words = [w for w in PROSE.split()]
    make = lambda i: " ".join(pick.choice(words) + ("!!" if i % 4 == 0 else "") for _ in range(40))
    docs = documents(spark, [(i, make(i), None, None, None, 0, "x", "x", "x", "x") for i in range(400)])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(3, None, 0), (None, 1, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels, max_rows=150)
    found = quality_classifier.scored(docs, model).collect()
    unseen = [r for r in found if r.held_out]
    assert 80 < len(unseen) < 190 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in unseen) >= 0.97 * len(unseen)
    again = quality_classifier.scored(docs, quality_classifier.fit(docs.repartition(7), labels, max_rows=150)).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in found})
    assert quality_classifier.scored(documents(spark), model).count() == len(rows())
    good = quality_classifier.good_documents(docs, labels, max_rows=150)
    assert good.columns == docs.columns and all(r.doc_id % 4 for r in good.collect())
    nothing = quality_classifier.fit(docs, labels.where("false"))
    assert {r.score for r in quality_classifier.scored(documents(spark), nothing).collect()} == {0.5}
    assert quality_classifier.scored(documents(spark, []), model).count() == 0


def test_exact_groups_of_odd_rows(spark):
    want = defaultdict(list)
    for doc_id, text, *_ in rows():
        want[hashlib.sha256((text or "").encode()).hexdigest()].append(doc_id)
    for historical in ("doc_id < 9", "true", "false", "doc_id % 2 = 0"):
        from pyspark.sql import functions as F

        found = exact_dedup.exact_groups(documents(spark), F.expr(historical)).collect()
        assert len(found) == len(rows())
        for r in found:
            group = want[r.text_sha256]
            keep = max((d for d in group if d is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), r.doc_id == keep)
    docs = documents(spark)
    kept = exact_dedup.deduplicated(docs, exact_dedup.earlier_half(docs))
    assert kept.columns == docs.columns
    assert sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept.collect()) == sorted(want)
    empty = documents(spark, [])
    assert exact_dedup.exact_groups(empty, exact_dedup.earlier_half(empty)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 2500, 8000])
def test_the_hash_is_perfect_and_minimal(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), dtype=np.uint8).reshape(-1, 32)
    seeds = exact_dedup.build_hash(digests)
    assert sorted(exact_dedup.slots_of(digests, seeds, n)) == list(range(n))


def test_urls(spark):
    urls = [
        "http://a.example.net/en/1?x", "http://EXAMPLE.net/en/", "http://example.net/de/", "http://notexample.com/de/", "http://x.example.com/de/2#t", "https://w.org/fr/",
        "http://org/fr/x", "http://net", "http://net/", "net/", "", None, "ftp://u@net:80/", "http://a.net?/en/", "x://y://net/", "http:///de/", "http://a.ORG/FR/", "http://b.org/fr",
    ]
    given = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, urls[0], "h", "r"), (None, None, None, None)]
    pages = spark.createDataFrame(given, "page_id long, url string, host string, rule string")
    rules = url_filters.RULES

    def judge(url):
        tail = (url or "").partition("://")[2]
        end = min([tail.find(c) for c in "/?#" if c in tail], default=len(tail))
        host, path = tail[:end].lower(), tail[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        return host, path, rule, verdict

    found = url_filters.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found])) == sorted(str((i, *judge(u))) for i, u, *_ in given)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filters.judged(pages, none, default="block").collect()} == {"block"}


def test_licenses(spark):
    scanner = license_scans.LicenseScanner(TEMPLATES)
    pick = random.Random(6)
    for name, text in TEMPLATES.items():
        words = text.split()
        assert [f[0] for f in scanner.scan("Some prose first.\n" + text + "\nAnd more prose after it.")] == [name]
        wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
        assert name in [f[0] for f in scanner.scan(PROSE + "\n" + wrapped)], name
        if len(words) > 25:  # few changed words are told, many are no license
            few = list(words)
            few[12] = "changed"
            assert [(n, d) for n, _, d in scanner.scan(" ".join(few))] in ([(name, 2)], [(name, 1)])
            many = [pick.choice(PROSE.split()) if i % 2 else w for i, w in enumerate(words)]
            assert scanner.scan(" ".join(many)) == []
    assert scanner.scan("He has a license to drive. " * 400) == []
    long = (PROSE + " license ") * 400 + TEMPLATES["MIT-text"] + (" warranty " + PROSE) * 400
    assert "MIT-text" in [f[0] for f in scanner.scan(long)]
    found = {r.doc_id: r for r in license_scans.scanned(documents(spark)).collect()}
    assert found[15].licenses == "MIT" and found[15].n_differences == 0
    assert sum(r.n_licenses for r in found.values()) == 1
    assert license_scans.scanned(documents(spark, [])).count() == 0
    assert {r.licenses for r in license_scans.scanned(documents(spark), {}).collect()} == {""}


@pytest.mark.parametrize("width", [1, 20, 40, 50, 72, 80])
@pytest.mark.parametrize("between", ["\n", "\n\n", "\n \n\n# "])
def test_licenses_in_lines_of_any_width(width, between):
    scanner = license_scans.LicenseScanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        wrapped = between.join(textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))
        assert [(n, d) for n, _, d in scanner.scan(PROSE + between + wrapped + between + PROSE)] == [(name, 0)], name


def test_close_relatives_are_told_apart():
    scanner = license_scans.LicenseScanner(TEMPLATES)
    notice = TEMPLATES["GPL-3.0-header"]
    short = "This work is licensed under the GNU {}General Public License, version {}."
    disclaimer = ' THIS SOFTWARE IS PROVIDED BY THE AUTHOR AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
    texts = {
        notice: ["GPL-3.0-header"],
        notice.replace("GNU General", "GNU Affero General"): ["AGPL-3.0-header"],
        notice.replace("GNU General", "GNU Lesser General"): ["LGPL-3.0-header"],
        notice.replace("version 3", "version 2"): ["GPL-2.0-header"],
        notice.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"): ["LGPL-2.1-header"],
        notice.replace("GNU General", "GNU Other General"): [],
        notice.replace("version 3", "version 7"): [],
        notice.replace("version 3", "version 3.0").replace("This program", "Foo"): ["GPL-3.0-header"],
        short.format("", "3"): ["GPL-3.0"],
        short.format("", "2"): ["GPL-2.0"],
        short.format("", "1"): [],
        short.format("Affero ", "3"): ["AGPL-3.0"],
        short.format("Other ", "3"): [],
        TEMPLATES["Apache-2.0-header"].replace("Apache License", "Educational Community License"): [],
        TEMPLATES["BSD-3-Clause"] + disclaimer: ["BSD-3-Clause"],
        TEMPLATES["BSD-clauses"] + disclaimer: ["BSD-2-Clause"],
        TEMPLATES["BSD-clauses"]: ["BSD-clauses"],
        "Licensed under CC BY 3.0.": ["CC-BY-3.0"],
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"],
    }
    for text, names in texts.items():
        assert [f[0] for f in scanner.scan(PROSE + "\n" + text + "\n" + PROSE)] == names, text
    together = "\n".join([notice.replace("version 3", "version 7"), notice, notice.replace("GNU General", "GNU Affero General")])
    assert sorted(f[0] for f in scanner.scan(together)) == ["AGPL-3.0-header", "GPL-3.0-header"]


def test_passages_in_two_pieces_count_once():
    scanner = license_scans.LicenseScanner(TEMPLATES)
    filler = ("license " + PROSE + " ").split() * 30
    for name in ("GPL-3.0", "BSD-3-Clause", "MIT"):
        for at in range(0, len(filler), 23):
            text = " ".join(filler[:at] + [TEMPLATES[name]] + filler[at:])
            assert [(n, d) for n, _, d in scanner.scan(text)] == [(name, 0)], (name, at)
    twice = " ".join(filler + [TEMPLATES["MIT"]] * 2 + filler)
    assert [f[0] for f in scanner.scan(twice)] == ["MIT", "MIT"]


def test_candidates_over_line_ends_reach_the_scanner(spark):
    docs = spark.createDataFrame([(1, "All rights\n\nreserved."), (2, "released into the public\n# domain\n" + PROSE)], "doc_id long, text string")
    found = {r.doc_id: (r.n_blocks, r.licenses) for r in license_scans.scanned(docs).collect()}
    assert found == {1: (1, "Reserved"), 2: (1, "")}


def test_near_groups_of_odd_rows(spark):
    unique = [r for r in rows() if r[0] is not None and r[0] != 14]
    want = near_components([r[:2] for r in unique])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(documents(spark, unique)).collect()}
    assert found == want
    everything = near_dedup.near_groups(documents(spark)).collect()
    assert len(everything) == len(rows()) and all(r.kept == (r.doc_id == r.component_id) for r in everything)
    assert all(r.component_id == 1 for r in everything if r.n_shingles == 19 or r.doc_id in (2, 3, 4))
    stays = near_dedup.representatives(documents(spark))
    assert stays.columns == documents(spark).columns
    ids = Counter(r.doc_id for r in stays.collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and not ids[4] and ids[14] == 2 and ids[9] == 1 and not ids[10]
    assert near_dedup.near_groups(documents(spark, [])).count() == 0


@pytest.mark.parametrize("long_list", [4096, 10])
def test_near_groups_equal_all_pairs(spark, monkeypatch, long_list):
    """Groups of edited copies around the threshold, with a line that all share, by both ways of comparing the unsettled."""
    monkeypatch.setattr(near_dedup, "LONG_LIST", long_list)
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    pick = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    made = []
    for group in range(6):
        base = [pick.choice(vocabulary) for _ in range(100)]
        for _ in range(25):
            words = list(base)
            for _ in range(pick.randint(0, 6)):
                words[pick.randrange(100)] = pick.choice(vocabulary)
            made.append((len(made), PROSE + "\n" + " ".join(words)))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs).collect()}
    assert found == near_components(made)


def test_components(spark):
    pick = random.Random(9)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2060)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
