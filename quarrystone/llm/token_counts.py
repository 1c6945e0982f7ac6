"""Token counts at every prefix, by dynamic programming over byte-level BPE.

For merge-ranked BPE a sequence of tokens is the encoding of its bytes exactly if each neighbouring pair is the
encoding of its own bytes.  So the encoding of a prefix ends in the one token t for which (last token of the
prefix before t, t) is such a pair, and its count is that prefix's count plus one.  One left-to-right pass gives
the exact count of every prefix of a word; texts are the sum of their words, since merges never cross words.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings inside a text are one token, as in
the library's default; texts with code points whose Unicode class the two regular-expression engines may see
differently are split by the library itself.  Repeated rows are counted each; very long texts are read
whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.base import arrow_map

TOKENIZER = "byte_bpe_50k.json"
#: Code points on which both engines have the same classes; others go to the library's splitter.
SHARED_CLASSES = re.compile("[^\x00-ͯḀ-ỿ‐-⁞₠-₿]")
#: Words, and runs of characters between blanks, kept with their prefix counts in a worker.
WORDS_KEPT = 900_000
PAIRS_KEPT = 1_000_000
#: Bytes of a word's beginning whose state is kept for other words that begin so.
STEM = 7


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable bytes stand for themselves, the others
    follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of all prefixes of texts."""

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_letters()
        raw = lambda token: bytes(of[c] for c in token)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.formed: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), i in self.rank.items():
            self.formed.setdefault(a + b, (i, a, b))
        #: Tokens that are the encoding of their own bytes.
        self.whole = {t for t in self.ids if len(t) == 1}
        for t, (i, a, b) in self.formed.items():
            if a in self.whole and b in self.whole and self.boundary_holds(a, b, i):
                self.whole.add(t)
        self.tails = {t[i:] for t in self.ids for i in range(len(t))}
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self.find = regex.compile(PATTERN).findall
        self.blank_in = regex.compile(r"\s\s").search
        self.blanks = regex.compile(r"\s{2,}(?=\S)").finditer
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.stems: dict[bytes, tuple[list[bytes], list[int]]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding by its definition: merge the pair of lowest rank, again and again."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.rank
        while len(parts) > 1:
            best, at = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 30:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stands(self, a: bytes, b: bytes) -> bool:
        """Whether a, b is the encoding of a + b."""
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self.boundary_holds(a, b) if a else b in self.whole
        return known

    def boundary_holds(self, a: bytes, b: bytes, before: int = 1 << 30) -> bool:
        """Undo, latest first, the merges at the right edge of a and the left edge of b: the boundary holds unless
        two edge parts would have merged before the merge that took one of them away."""
        rank, formed = self.rank, self.formed
        while True:
            if rank.get((a, b), 1 << 30) < before:
                return False
            of_a, of_b = formed.get(a), formed.get(b)
            if of_a and (not of_b or of_a[0] > of_b[0]):
                before, a = of_a[0], of_a[2]
            elif of_b:
                before, b = of_b[0] + 1, of_b[1]
            else:
                return True

    def prefixes(self, word: bytes) -> list[int]:
        """Token counts of word[:0], word[:1] and so on."""
        ids, tails, stands, n = self.ids, self.tails, self.stands, len(word)
        first = word[:STEM]
        if n > STEM and (stem := self.stems.get(first)):
            begin, last, count = STEM + 1, stem[0] + [b""] * (n - STEM), stem[1] + [0] * (n - STEM)
        else:
            begin, last, count = 1, [b""] * (n + 1), [0] * (n + 1)
        for end in range(begin, n + 1):
            start, ends = end - 1, []
            while start >= 0 and (t := word[start:end]) in tails:
                if t in ids:
                    ends.append((start, t))
                start -= 1
            for start, t in reversed(ends):
                if stands(last[start], t):
                    last[end], count[end] = t, count[start] + 1
                    break
        if begin == 1 and n > STEM:
            if len(self.stems) >= WORDS_KEPT // 16:
                self.stems.clear()
            self.stems[first] = last[: STEM + 1], count[: STEM + 1]
        return count

    def steps(self, word: str) -> bytes:
        """What each character of a word adds to the count, as int8."""
        if (known := self.words.get(word)) is None:
            data = word.encode()
            count = self.prefixes(data)
            if len(data) == len(word):
                known = bytes((b - a) & 255 for a, b in zip(count, count[1:], strict=False))
            else:
                ends = np.cumsum([0, *(len(c.encode()) for c in word)])
                known = np.diff(np.array(count)[ends]).astype(np.int8).tobytes()
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = known
        return known

    def split(self, text: str) -> list[str]:
        if not text.isascii() and SHARED_CLASSES.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.find(text)

    def run_steps(self, run: str, lead: str = " ") -> bytes | None:
        """Steps of a blank and the run behind it, from text where single blanks stand between runs; None if what
        is next to the run, or inside it, makes some prefixes end in other words."""
        if not run or run[0].isspace() or run[-1].isspace() or self.blank_in(run):
            return None
        words = self.find(lead + run)
        if not CLIPPED.isdisjoint(words):
            return None
        known = b"".join([self.steps(w) for w in words])
        if lead and len(run) <= 64:
            if len(self.runs) >= WORDS_KEPT:
                self.runs.clear()
            self.runs[run] = known
        return known

    def plain(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text without special strings; [0] is 0."""
        if text.isascii() or not SHARED_CLASSES.search(text):
            first, *runs = text.split(" ")
            known, steps = self.runs, self.run_steps
            parts = [steps(first, ""), *[known.get(r) or steps(r) for r in runs]]
            if None not in parts:
                out = np.zeros(len(text) + 1, np.int32)
                np.cumsum(np.frombuffer(b"".join(parts), np.int8), dtype=np.int32, out=out[1:])
                return out
        words = self.split(text)
        known = self.words
        data = b"".join([known.get(w) or self.steps(w) for w in words])
        out = np.zeros(len(text) + 1, np.int32)
        np.cumsum(np.frombuffer(data, np.int8), dtype=np.int32, out=out[1:])
        # A prefix that ends inside an apostrophe word sees two words.
        if "'" in text and not CLIPPED.isdisjoint(words):
            at = 0
            for w in words:
                if w in CLIPPED:
                    out[at + 2] = out[at] + self.total("'") + self.total(w[1])
                at += len(w)
        # A prefix that ends behind two or more blanks sees them as one word, whatever follows in the text.
        for m in self.blanks(text):
            out[m.end()] = out[m.start()] + self.total(m[0])
        return out

    def total(self, word: str) -> int:
        return int(np.frombuffer(self.steps(word), np.int8).sum(dtype=np.int32))

    def counts(self, text: str) -> np.ndarray:
        """Exact token counts of text[:0], text[:1], ..., text."""
        if not any(s in text for s in self.specials):
            return self.plain(text)
        out, at, base = [np.zeros(1, np.int32)], 0, 0
        for m in self.special.finditer(text):
            # Inside a special string its letters are ordinary text, so the piece runs on to its last letter but one.
            piece = self.plain(text[at : m.end() - 1])
            out += [base + piece[1:], np.array([base + piece[m.start() - at] + 1], np.int32)]
            base, at = int(out[-1][0]), m.end()
        out.append(base + self.plain(text[at:])[1:])
        return np.concatenate(out).astype(np.int32)


#: Words of the pattern whose beginnings are two words.
CLIPPED = {"'re", "'ve", "'ll"}


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for each Python worker, kept between tasks."""
    return PrefixCounter(path)


def cut_for_budget(counts: np.ndarray, budget: int) -> int:
    """The characters of the longest prefix of at most budget tokens."""
    if counts[-1] <= budget:
        return len(counts) - 1
    return int(np.nonzero(counts <= budget)[0][-1])


def tokens_between(counts: np.ndarray, start: int, end: int) -> int:
    """Tokens that text[:end] has more than text[:start]."""
    return int(counts[end] - counts[start])


def prefix_token_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", block: int = 1024) -> DataFrame:
    """The stored form: for each block of characters of a text, the token counts of the prefixes that end in it
    (at = the first one's length).  Rows are bounded, so a text of any length fits, and any prefix is one lookup."""

    def make():
        c = counter(path)

        def work(cols):
            out = [[], [], []]
            for k, t in zip(*cols, strict=True):
                n = c.counts(t or "")
                for at in range(0, len(n), block):
                    for column, v in zip(out, (k, at, n[at : at + block].tolist()), strict=True):
                        column.append(v)
            return out

        return work

    kind = dict(docs.dtypes)[key]
    return arrow_map(docs, make, [key, text], f"{key} {kind}, at long, n_tokens array<int>")


def tokens_of_prefix(prefixes: DataFrame, asked: DataFrame, key: str = "doc_id", length: str = "prefix_chars", block: int = 1024) -> DataFrame:
    """Answers from the stored form: asked has the key and the length of a prefix; adds n_tokens (null where the
    text is shorter)."""
    asked = asked.withColumn("at", (F.col(length) - F.col(length) % block).cast("long"))
    got = asked.join(prefixes.withColumnRenamed("n_tokens", "stored"), [key, "at"], "left")
    return got.withColumn("n_tokens", F.get("stored", (F.col(length) % block).cast("int"))).drop("stored", "at")


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit (more than limit tokens) and cut_chars, the characters of the
    longest prefix within the limit.  All three are read off the counts of all prefixes."""

    def make():
        c = counter(path)

        def work(cols):
            keys, n_bytes, n_tokens, cut = [], [], [], []
            for k, t in zip(*cols, strict=True):
                n = c.counts(t or "")
                keys.append(k)
                n_bytes.append(len((t or "").encode()))
                n_tokens.append(int(n[-1]))
                cut.append(cut_for_budget(n, limit))
            return [keys, n_bytes, n_tokens, [x > limit for x in n_tokens], cut]

        return work

    kind = dict(docs.dtypes)[key]
    return arrow_map(docs, make, [key, text], f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")
