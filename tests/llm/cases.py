"""Awkward documents that every operator must take, and plain versions of shared definitions."""

import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, digest string, token string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun of the late afternoon while birds sing"


def rows():
    """Nulls in every column, empty and blank texts, a very long text and word, copies, near copies, repeated rows, ties."""
    near = PROSE.split()
    texts = [
        (1, PROSE), (2, PROSE), (3, PROSE.upper()), (4, " ".join(near[:-1] + ["rest"])), (5, ""), (6, None), (7, " \t\n\x0b\f\r "), (8, "one"),
        (9, "one two three four"), (10, "one two three four"), (11, "x" * 50_000), (12, (PROSE + "\n") * 400), (13, "é ü 漢字 \x1c\x85　 😀 <|endoftext|>"),
        (14, "a b c d e"), (14, "a b c d e"), (14, "other words under the same id"), (None, PROSE), (None, None), (15, "MIT\nReleased under the MIT License.\n" + PROSE),
        (16, "$$$ *** ### &&& " * 40), (17, "Again again again " * 60), (18, "  double  spaces\n\n\nand lines\n\nand lines\n"), (2**62, "far id"), (-5, "minus id"),
    ]
    extra = ("mine", "mine", "mine", "mine")
    made = []
    for i, (doc_id, text) in enumerate(texts):
        source = None if i % 7 == 3 else f"s{i % 3}"
        made.append((doc_id, text, None if i % 5 == 4 else "en", source, None if text is None else len(text), i, *extra))
    return made


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def near_components(docs):
    """doc_id -> smallest linked doc_id over (doc_id, text) with unique ids, by comparing all pairs."""
    sets = {}
    for doc_id, text in docs:
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(s), find(d)) for d, s in sets.items()}


def by_id(frame):
    found = defaultdict(list)
    for row in frame.collect():
        found[row.doc_id].append(row)
    return found
