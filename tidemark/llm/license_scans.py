"""License scans (operator 1) by conditional compression.

Words that licenses use, and as many words before and after them as the longest template may have, form candidate blocks;
blocks that touch are one. Only words count, so neither the width of lines nor blank lines matter. Each block is compressed
alone and with each template as a raw zstandard dictionary; a template that the block repeats saves the most bytes. Templates
are ranked by that reduction and confirmed by wording: the block's words are aligned with the template's, and words that are
missing, or stand between, may be ``MAX_DIFFERENCES`` of a template's words at most, and none of the words of its name and
version (``REQUIRED``). Of the confirmed templates the one with most equal words less differing ones counts, so that close
relatives are told apart and a long notice goes before a short one within it. Its passage is taken out and the rest of its
block is ranked again, so that a block may hold several licenses.

The JVM tests whole texts for candidate words first, and only texts that have one reach Python, where they were read: no
shuffle, so hot sources and copies don't matter. Very long blocks are cut into overlapping pieces, so that no part is left
out and the alignment's cost stays bounded; of passages of two pieces that overlap the one that agrees best counts.

Defined results: null and empty texts have no candidates; of templates that agree equally well the larger reduction wins, then the first by name;
repeated rows are scanned each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, whole_text
from tidemark.llm.license_templates import REQUIRED, TEMPLATES

#: Words that candidate blocks have, on one line or on several: fixed values.
CANDIDATE = r"licen[sc]|copyright|permission[\W_]+is[\W_]+hereby|redistribut|rights[\W_]+reserved|public[\W_]+domain|warrant"
MIN_REDUCTION, MAX_DIFFERENCES = 4, 0.1
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class LicenseScanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = dict(sorted(templates.items()))

    @cached_property
    def words(self) -> dict[str, list[str]]:
        return {name: words_of(text) for name, text in self.templates.items()}

    @cached_property
    def required(self) -> dict[str, list[re.Pattern]]:
        return {name: [re.compile(rf"(?<!\S)(?:{x})(?!\S)") for x in REQUIRED.get(name, ())] for name in self.templates}

    @cached_property
    def compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        given = {name: zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for name, words in self.words.items()}
        return {name: zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_dict_id=False) for name, d in given.items()}

    @cached_property
    def plain(self) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=9, write_content_size=False)

    @cached_property
    def counts(self) -> dict[str, Counter]:
        return {name: Counter(words) for name, words in self.words.items()}

    def blocks(self, text: str) -> list[list[tuple[str, bool, int]]]:
        """Words of the candidate blocks, each with whether its line lies among lines with candidates and not just around
        them, and its number in the text; of blocks longer than four of the longest template, in overlapping pieces."""
        text = text.lower()
        found = list(WORD.finditer(text))
        starts, breaks = [m.start() for m in found], [m.start() for m in re.finditer("\n", text)]
        longest = max(map(len, self.words.values()), default=1)
        around, size = int(longest * (1 + MAX_DIFFERENCES)) + 1, 4 * longest + 4
        runs: list[list[int]] = []  # words of the block, and of its lines with candidates
        for hit in re.finditer(CANDIDATE, text):
            first, last = bisect_right(starts, hit.start()) - 1, bisect_left(starts, hit.end())
            before, after = bisect_left(breaks, hit.start()), bisect_left(breaks, hit.end())
            line = bisect_left(starts, breaks[before - 1]) if before else 0
            line_end = bisect_left(starts, breaks[after]) if after < len(breaks) else len(starts)
            low, high = max(0, first - around), min(len(starts), last + around)
            if runs and low <= runs[-1][1]:
                runs[-1][1], runs[-1][3] = high, line_end
            else:
                runs.append([low, high, line, line_end])
        pieces = []
        for low, high, inside, outside in runs:
            words = [(found[i].group(), inside <= i < outside, i) for i in range(low, high)]
            for start in range(0, max(1, len(words) - around), size - around):
                pieces.append(words[start : start + size])
        return pieces

    def ranked(self, block: list[tuple[str, bool, int]]) -> list[tuple[int, str]]:
        """Templates by how many bytes they save of the block or of its lines with candidates, most first; without those of
        whose words the block has too few."""
        has = Counter(word for word, _, _ in block)
        fits = [name for name, need in self.counts.items() if (need - has).total() <= MAX_DIFFERENCES * len(self.words[name])]
        saved: dict[str, int] = {}
        for words in ([word for word, _, _ in block], [word for word, inside, _ in block if inside]):
            given = " ".join(words).encode()
            alone = len(self.plain.compress(given)) if fits else 0
            for name in fits:
                saved[name] = max(saved.get(name, 0), alone - len(self.compressors[name].compress(given)))
        return sorted(((x, name) for name, x in saved.items() if x >= MIN_REDUCTION), key=lambda x: (-x[0], x[1]))

    def passage(self, name: str, words: list[str]) -> tuple[int, int, int] | None:
        """Words that differ between a template and the passage of the block that resembles it, and that passage; none if
        no passage is confirmed. A place that fails is left out and the next one is tried."""
        template = self.words[name]
        most = int(MAX_DIFFERENCES * len(template))
        least = -(-(len(template) - most) // (most + 1))  # equal words in a row that any confirmed passage has
        words = list(words)
        while True:
            core = SequenceMatcher(None, template, words, autojunk=False).find_longest_match()
            if core.size < max(1, least):
                return None
            low = max(0, core.b - int(core.a * (1 + MAX_DIFFERENCES)) - 1)
            high = core.b + core.size + int((len(template) - core.a - core.size) * (1 + MAX_DIFFERENCES)) + 1
            matches = [m for m in SequenceMatcher(None, template, words[low:high], autojunk=False).get_matching_blocks() if m.size]
            same = sum(m.size for m in matches)
            start, end = low + matches[0].b, low + matches[-1].b + matches[-1].size
            differ = len(template) - same + (end - start) - same
            if differ <= most and all(x.search(" ".join(words[start:end])) for x in self.required[name]):
                return differ, start, end
            words[core.b : core.b + core.size] = ["\n"] * core.size

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(license, reduction, differences) of each confirmed passage, in the text's order."""
        found = []
        for piece, block in enumerate(self.blocks(text)):
            while block:
                confirmed = []
                for reduction, name in self.ranked(block):
                    if passage := self.passage(name, [word for word, _, _ in block]):
                        differ, start, end = passage
                        equal = (len(self.words[name]) + end - start - differ) // 2
                        confirmed.append((equal - differ, reduction, name, differ, start, end))
                if not confirmed:
                    break
                agree, reduction, name, differ, start, end = max(confirmed, key=lambda x: x[0])  # the first of equals: ranked
                found.append((agree, block[start][2], block[end - 1][2] + 1, piece, name, reduction, differ))
                block = block[:start] + [("\n", False, -1)] + block[end:]
        found.sort(key=lambda x: x[1:4])
        kept: list[tuple] = []
        for x in found:
            while kept and kept[-1][3] != x[3] and x[1] < kept[-1][2] and x[0] > kept[-1][0]:
                kept.pop()
            if not kept or kept[-1][3] == x[3] or x[1] >= kept[-1][2]:
                kept.append(x)
        return [x[4:] for x in kept]


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_blocks, n_licenses, licenses`` (distinct names in order, by commas)``, best_reduction, n_differences`` of
    every row of ``docs`` (doc_id, text)."""
    templates = TEMPLATES if templates is None else templates
    names = ["doc_id", "n_blocks", "n_licenses", "licenses", "best_reduction", "n_differences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                found = scanner.scan(text) if text is not None else []
                rows.append(
                    (
                        len(scanner.blocks(text)) if text is not None else 0, len(found), ",".join(sorted({f[0] for f in found})),
                        max((f[1] for f in found), default=0), sum(f[2] for f in found),
                    )
                )
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    text = whole_text()
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(f"(?i){CANDIDATE}"), text).alias("text"))
    return given.mapInArrow(run, "doc_id long, n_blocks long, n_licenses long, licenses string, best_reduction long, n_differences long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
