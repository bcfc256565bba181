"""Scoring texts for abusive, threatening, hateful and sexually explicit language.

A text is folded (compatibility forms, look-alike letters, invisible characters) and
cut into words.  Each different word is looked up in a trie of the lexicon walked
together with the word's Levenshtein automaton, so misspelled terms are found
without comparing with every term; words spelled out with signs or digits in place
of letters are put together first.  A word of the ordinary vocabulary, a fixed public list
(`ordinary_words`), is no misspelling.  Patterns of word classes are matched on the words so mended.
Hits are weighed by their kind: strong term, weak term or pattern, each in its window of words: aimed at a
person, about the speaker, talk about terms, or plain.  Repeated messages count but are told apart.

Reviews, where there are any, teach two things, from at most `LABELLED` reviewed documents: the weight
of each kind, the fixed one counting as `PRIOR` reviewed hits; and phrases of three to
five words that only abusive documents have, beyond chance (`LOG_RATIO`).  Given the reviews,
a document's score depends on its own text alone.

score = 1 - product of (1 - weight) over hits, of the learned phrases the best one; a document with
`FOUND` or more counts.  Null and wordless texts score 0.

Limits: a misspelled term keeps its first letter; terms under five letters are found behind
masks and stand-ins only, five letters with one edit when they are aimed at a person.
"""

from __future__ import annotations

import base64
import re
import sys
import types
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from recollex.llm import abuse_terms as T
from recollex.llm.mixing import plain_source
from recollex.llm.tokens import VOCABULARY

FOUND = 0.5
#: Weights of kinds of hits, and how many reviewed hits each counts as.
WEIGHTS = {
    "strong aimed": 0.75, "strong plain": 0.6, "strong own": 0.12, "strong mention": 0.12, "weak aimed": 0.55, "weak plain": 0.15, "weak own": 0.03, "weak mention": 0.03,
    "mended aimed": 0.7, "mended plain": 0.45, "mended own": 0.1, "mended mention": 0.1, "pattern plain": 0.75, "pattern mention": 0.15, "pattern mended": 0.7,
}
PRIOR = 30
#: Reviewed documents that are learned from at most, words of a learned phrase, abusive documents that have it at least,
#: their least part of the reviewed documents with it, and twice the log-likelihood ratio to chance that it must reach.
LABELLED = 50_000
PHRASE_WORDS = (3, 4, 5)
PHRASE_LEAST, PHRASE_PART, LOG_RATIO = 4, 0.75, 16.5
CATEGORIES = ("insult", "threat", "hate", "sexual")
#: Public vocabularies whose whole words are ordinary ones.
ORDINARY = (VOCABULARY, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
MEMO = 300_000
#: Words on both sides that are looked at.
WINDOW = 6

_WORD = re.compile(r"[^\W_]+(?:['’*$@!][^\W_]+)*[*$@]*|[$@][^\W_]+")
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*•·])[^\W_])(?:\1[^\W_]){1,14}(?![^\W_])")
_MASKED = re.compile(r"(?<![^\W_])[^\W\d_]+(?:[*%#@$!+-]{1,3}[^\W\d_]+){1,3}(?![^\W_])")
_CHINESE_RUN = re.compile("[㐀-鿿]")
_CHINESE_BACK = re.compile("|".join(T.CHINESE_BACK.split()))
_CHINESE_GAP = re.compile(r"(?<=[㐀-鿿])[ .*_\-·~]+(?=[㐀-鿿])")
_TRIPLED, _DOUBLED = re.compile(r"(.)\1{2,}"), re.compile(r"(.)\1+")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


def _pairs(text: str) -> dict[str, str]:
    return dict(zip(text[::2], text[1::2]))


_FOLD = str.maketrans(_pairs(T.LOOKALIKES))
_ALIKE = re.compile(f"[{T.LOOKALIKES[::2]}]")
_STAND_INS = str.maketrans(_pairs(T.STAND_INS))


class Trie:
    """Terms by letters; `near` walks it with the automaton of a word."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term

    def near(self, word: str, distance: int) -> tuple[str, int] | None:
        """The nearest term within the distance, whose first letter is the word's.

        The state of the automaton is its row of least edits per letter read; neighbours
        that changed places count one edit.
        """
        start = self.root.get(word[:1])
        if start is None:
            return None
        best: tuple[int, str] | None = None
        n = len(word)
        stack = [(start, list(range(1, -1, -1)) + list(range(1, n)), list(range(n + 1)), word[0])]
        while stack:
            node, state, before, letter = stack.pop()
            if "" in node and state[n] <= distance and (best is None or (state[n], node[""]) < best):
                best = (state[n], node[""])
            for next_letter, child in node.items():
                if not next_letter:
                    continue
                left = state[0] + 1
                new, least, above = [left], left, state[0]
                for i, wanted in enumerate(word):
                    here = state[i + 1]
                    edits = above if wanted == next_letter else above + 1
                    if here < edits:
                        edits = here + 1
                    if left < edits:
                        edits = left + 1
                    if i and wanted == letter and word[i - 1] == next_letter and before[i - 1] < edits:
                        edits = before[i - 1] + 1
                    new.append(edits)
                    if edits < least:
                        least = edits
                    left, above = edits, here
                if least <= distance:
                    stack.append((child, new, state, next_letter))
        return (best[1], best[0]) if best else None


def allowed_edits(word: str, term: str) -> int:
    """Edits that make a word a misspelling of a term: one from five letters on, two from ten."""
    least = min(len(word), len(term))
    return 0 if len(term) < 5 or least < 4 else 1 if least < 10 else 2


def folded(text: str) -> str:
    """Lower-case text in compatibility form, without invisible characters and look-alike letters
    next to Latin ones."""
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFKC", text).lower()
    if _INVISIBLE.search(plain):
        plain = _INVISIBLE.sub("", plain)
    return plain.translate(_FOLD) if _ALIKE.search(plain) else plain


def ordinary_words(files: tuple[str, ...] = ORDINARY) -> frozenset[str]:
    """Words of four letters or more that public vocabularies hold whole; files of a fixed size."""
    words = set()
    for file in files:
        for line in Path(file).read_bytes().splitlines():
            piece = base64.b64decode(line.split()[0])
            if piece.startswith(b" ") and (word := piece[1:].decode("utf-8", "ignore")).isalpha() and len(word) >= 4:
                words.add(word.lower())
    return frozenset(words)


Step = frozenset | None  # words, or a gap of up to three


def pattern_steps(pattern: str) -> list[Step]:
    """The places of a pattern: the words that may stand in each, None for a gap."""
    steps: list[Step] = []
    for part in pattern.replace("'", " ").split():
        if part == "_":
            steps.append(None)
        elif part[0] == "{":
            steps.append(frozenset(T.CLASSES[part[1:-1]].split()))
        else:
            steps.append(frozenset(part.strip("()").split("/")))
    return steps


class Lexicon:
    """Terms, patterns and the memory of looked-up words."""

    def __init__(self, ordinary: frozenset[str] = frozenset()):
        self.ordinary = ordinary
        self.category: dict[str, str] = {}
        for category, terms in T.STRONG.items():
            self.category |= {t: category for term in terms.split() if (t := term.replace("-", ""))}
        self.weak = {t.replace("-", "") for t in T.WEAK.split()} - set(self.category)
        self.patterns: dict[str, list[tuple[list[Step], str]]] = {}
        vocabulary = set()
        for category, lines in [*T.PATTERNS.items(), ("", T.HARMLESS)]:
            for pattern in re.split(r"[|\n]", lines):
                if steps := pattern_steps(pattern):
                    vocabulary |= {w for step in steps if step for w in step}
                    for word in steps[0]:
                        self.patterns.setdefault(word, []).append((steps, category))
        for options in self.patterns.values():
            options.sort(key=lambda o: o[1] != "")  # harmless ones first
        self.known = set(self.category) | self.weak | vocabulary
        self.trie = Trie(sorted({t for t in self.category if len(t) >= 5} | {t for t in self.weak | vocabulary if len(t) >= 6}))
        self.telling = set(self.category) | self.weak | set(self.patterns)
        self.address, self.links, self.self_ = set(T.ADDRESS.split()), set(T.LINKS.split()), set(T.SELF.replace("'", " ").split())
        self.self_phrases = [p.replace("'", " ").split() for p in T.SELF_PHRASES.split("|")]
        self.mention, self.quoting = set(T.MENTION.split()), set(T.QUOTING.split())
        self.chinese = [(c, re.compile("|".join(ps.split()))) for c, ps in T.CHINESE.items()]
        self.memo: dict[str, tuple[str, int]] = {"u": ("you", 0), "ur": ("your", 0), "r": ("are", 0), "ya": ("you", 0)}
        self.start = dict(self.memo)
        self.masks: dict[str, str] = {}
        self.hashes: dict[str, int] = {}
        self.by_shape: dict[tuple[str, int], list[str]] = {}
        for t in sorted((set(self.category) | self.weak | vocabulary) - self.ordinary | set(self.category) | self.weak):
            if len(t) >= 4:
                self.by_shape.setdefault((t[0], len(t)), []).append(t)

    def canonical(self, word: str) -> tuple[str, int]:
        """(the term or pattern word that a word stands for, or itself; 1 if a misspelling was mended, 2 if doubtful)."""
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > MEMO:
                self.memo = dict(self.start)
            known = self.memo[word] = self._look_up(word)
        return known

    def _look_up(self, word: str) -> tuple[str, int]:
        if word in self.known:
            return word, 0
        plain = word
        if not word.isalpha():
            if word.isdigit():
                return word, 0
            plain = word.replace("’", "").replace("'", "").translate(_STAND_INS)
            if plain in self.known:
                return plain, 0
            if "*" in plain and len(plain) >= 4:
                pattern = re.compile("".join("[a-z]" if c == "*" else re.escape(c) for c in plain))
                hits = sorted(t for t in (*self.category, *self.weak) if pattern.fullmatch(t))
                if hits:
                    return hits[0], 0
            if not plain.isalpha():
                return word, 0
        if plain in self.ordinary:
            return plain, 0
        spellings = [plain]
        if _DOUBLED.search(plain):
            spellings = [_TRIPLED.sub(r"\1\1", plain), _DOUBLED.sub(r"\1", plain)]
        for once in spellings:
            if once != word and (once in self.category or once in self.weak and len(once) > 3):
                return once, 0
            if once[-1] in "sn":
                for ending in ("s", "es") if once[-1] == "s" else ("n", "en"):
                    stem = once[: -len(ending)]
                    if once.endswith(ending) and (stem in self.category or stem in self.weak and len(stem) > 3):
                        return stem, 0
        if 4 <= len(plain) <= 24:
            hit = self.trie.near(plain, 1 if len(plain) < 10 else 2)
            if hit and hit[1] <= allowed_edits(plain, hit[0]):
                # short terms, and those that another ending makes another word of, are doubtful
                return hit[0], 2 if sorted(plain) != sorted(hit[0]) and (len(hit[0]) < 6 or plain[: len(hit[0]) - 1] == hit[0][:-1]) else 1
        return plain, 0

    def unmasked(self, word: str) -> str:
        """A term with some letters behind signs, made whole; other words as they are."""
        known = self.masks.get(word)
        if known is None:
            if len(self.masks) > MEMO:
                self.masks = {}
            known = word
            for ending in ("", "s", "es"):
                stem = word[: len(word) - len(ending)] if word.endswith(ending) else ""
                hits = [t for t in self.by_shape.get((stem[:1], len(stem)), ()) if all(a == b or not a.isalnum() for a, b in zip(stem, t))]
                if hits:
                    known = hits[0]
                    break
            self.masks[word] = known
        return known

    def read(self, text: str | None) -> tuple[str, list[str], list[tuple[str, int]]]:
        """The folded text, its words, and what they stand for; nothing of no text."""
        if not text or text.isspace():
            return "", [], []
        plain = folded(text)
        plain = _SPELLED.sub(lambda m: m[0].replace(m[1], ""), plain)
        plain = _MASKED.sub(lambda m: self.unmasked(m[0]), plain)
        words = [w for word in _WORD.findall(plain) for w in (word.replace("’", "'").split("'") if "'" in word or "’" in word else (word,)) if w]
        memo, canonical = self.memo, self.canonical
        return plain, words, [memo.get(w) or canonical(w) for w in words]

    def hits(self, text: str | None) -> list[tuple[str, str, str, bool]]:
        """(category, term, kind, quoted) of each hit; no text has none."""
        return self._hits(*self.read(text))

    def _hits(self, plain: str, words: list[str], same: list[tuple[str, int]]) -> list[tuple[str, str, str, bool]]:
        found: list[tuple[str, str, str, bool]] = []
        if _CHINESE_RUN.search(plain):
            together = _CHINESE_GAP.sub("", plain)
            for category, pattern in self.chinese:
                for m in pattern.finditer(together):
                    back = _CHINESE_BACK.search(together, max(0, m.start() - 6), m.start())
                    found.append((category, m[0], "pattern mention" if back else "pattern plain", any(q in together[max(0, m.start() - 60) : m.start()] for q in self.quoting)))
        telling, past = self.telling, -1
        for i in [i for i, (term, _) in enumerate(same) if term in telling]:
            term, mended = same[i]
            if i <= past:
                continue  # within a harmless turn
            hit = self._pattern(same, i)
            window = [t for t, _ in same[max(0, i - WINDOW) : i]]
            if hit and not hit[0]:
                past = hit[2]
                continue
            if hit:
                category, name = hit[:2]
                kind = "pattern mention" if self._mentioned(plain, words, same, i) else "pattern mended" if hit[3] else "pattern plain"
            elif term in self.category or term in self.weak:
                strong = term in self.category and mended < 2
                category, name = self.category.get(term, "insult"), term
                if self._own(window):
                    context = "own"
                elif self._mentioned(plain, words, same, i):
                    context = "mention"
                else:
                    context = "aimed" if self._aimed(same, i) else "plain"
                kind = f"{('mended' if mended else 'strong') if strong else 'weak'} {context}"
            else:
                continue
            found.append((category, name, kind, any(w in self.quoting for w in window)))
        return found

    def _pattern(self, same: list[tuple[str, int]], at: int) -> tuple[str, str, int, bool] | None:
        """(category or '', words, last place, whether a telling word was mended) of a pattern that begins here."""
        for steps, category in self.patterns.get(same[at][0], ()):
            j, used, gap, ok = at, [], 0, True
            for step in steps:
                if step is None:
                    gap += 3
                    continue
                for k in range(j, min(j + gap + 1, len(same))):
                    if same[k][0] in step:
                        used.append(k)
                        j, gap = k + 1, 0
                        break
                else:
                    ok = False
                    break
            if ok:
                return category, " ".join(same[k][0] for k in used), j - 1, any(same[k][1] for k in used)
        return None

    def _aimed(self, same: list[tuple[str, int]], at: int) -> bool:
        """Whether the words before or after lead from the term to a person: "you are a complete ...", "... you"."""
        insult = lambda t: t in self.category or t in self.weak
        followed = at + 1 < len(same) and insult(same[at + 1][0])
        for k in range(at - 1, max(-1, at - 5), -1):
            t = same[k][0]
            if t in self.address:
                return t not in T.LOOSE or t in T.CLOSE and k == at - 1 or followed
            if t not in self.links and not insult(t):
                break
        return followed or same[at + 1 : at + 2] == [("you", 0)]

    def _mentioned(self, plain: str, words: list[str], same: list[tuple[str, int]], at: int) -> bool:
        """Whether a term is talked about and not aimed at a person: "the term ...", "... in the blocklist", in quotation marks near such a word."""
        near = [t for t, _ in same[max(0, at - WINDOW) : at + 1 + WINDOW]]
        if not any(t in self.mention for t in near):
            return False
        if any(t in self.address and t not in ("these", "those") for t, _ in same[max(0, at - 4) : at + 2]) and self._aimed(same, at):
            return False
        k = at - 1
        while k >= 0 and (same[k][0] in self.category or same[k][0] in self.weak or same[k][0] in ("and", "or", "like")):
            k -= 1
        if k >= 0 and same[k][0] in self.mention:
            return True
        after = [t for t, _ in same[at + 1 : at + 5]]
        if after[:1] and after[0] in ("in", "on", "from", "to") and any(t in self.mention for t in after[1:]):
            return True
        return len(re.findall(rf"[\"'`“‘«„]{re.escape(words[at])}[\"'`”’»“]", plain)) >= words.count(words[at])

    def _own(self, window: list[str]) -> bool:
        if window and window[-1] in self.self_ or len(window) > 1 and window[-2] in ("ich", "bin") and window[-1] not in self.address:
            return True
        text = window[-5:]
        return any(text[k : k + len(p)] == p for p in self.self_phrases for k in range(len(text)))

    def tokens(self, same: list[tuple[str, int]]) -> list[str]:
        """What phrases are learned of: the words as they were mended, and single CJK characters."""
        return [t for term, _ in same for t in (term if _CHINESE_RUN.search(term) else (term,))]

    def hashed(self, same: list[tuple[str, int]]) -> np.ndarray:
        """Hashes of `tokens`."""
        memo = self.hashes
        if len(memo) > MEMO:
            memo.clear()
        made: list[int] = []
        for term, _ in same:
            known = memo.get(term)
            if known is None:
                known = memo[term] = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in self.tokens([(term, 0)])]
            made += known
        return np.array(made, dtype=np.uint64)


def phrases(hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(words, hashes of all runs of so many) for each length of a phrase."""
    made = []
    for n in PHRASE_WORDS:
        if len(hashes) < n:
            break
        run = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            run = (run ^ hashes[k : len(hashes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            run ^= run >> np.uint64(29)
        made.append((n, run))
    return made


@dataclass
class Learned:
    """What reviews taught: weights of kinds, and phrases with weight and category."""

    kinds: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    phrases: dict[str, tuple[float, str]] = field(default_factory=dict)
    words: frozenset[str] = frozenset()

    def phrase(self, tokens: list[str]) -> tuple[float, str, str] | None:
        """(weight, category, phrase) of the best phrase of a text: looked for where words of phrases follow each other."""
        words, best, start = self.words, None, 0
        for i, token in enumerate([*tokens, ""]):
            if token in words:
                continue
            if i - start >= PHRASE_WORDS[0]:
                for n in PHRASE_WORDS:
                    for at in range(start, i - n + 1):
                        found = self.phrases.get(" ".join(tokens[at : at + n]))
                        if found and (best is None or found[0] > best[0]):
                            best = *found, " ".join(tokens[at : at + n])
            start = i + 1
        return best


def score(weights: list[float]) -> float:
    left = 1.0
    for weight in weights:
        left *= 1 - weight
    return 1 - left


def scored(lexicon: Lexicon, known: Learned, text: str | None) -> tuple[float, float, str | None, list[str]]:
    """(score, score of quoted hits alone, category of the greatest weight, terms) of a text."""
    plain, words, same = lexicon.read(text)
    if not words:
        return 0.0, 0.0, None, []
    hits = [(known.kinds[kind], category, term, quoted) for category, term, kind, quoted in lexicon._hits(plain, words, same)]
    if known.phrases and (phrase := known.phrase(lexicon.tokens(same) if _CHINESE_RUN.search(plain) else [t for t, _ in same])):
        hits.append((*phrase, False))
    if not hits:
        return 0.0, 0.0, None, []
    return score([h[0] for h in hits]), score([h[0] for h in hits if h[3]]), max(hits, key=lambda h: (h[0], h[1]))[1], sorted({h[2] for h in hits})


def worker_lexicon(ordinary) -> Lexicon:
    """The lexicon of a Python worker: what it has looked up serves all its tasks."""
    held = sys.modules.setdefault("_recollex_worker", types.ModuleType("_recollex_worker"))
    if not hasattr(held, "lexicon"):
        held.lexicon = Lexicon(ordinary.value)
    return held.lexicon


def _key(kind: str) -> int:
    return xxhash.xxh3_64_intdigest(kind.encode())


def _evidence(ordinary) -> Callable:
    """(doc_id, text, rate, category) of reviewed documents to (key, n, abusive, one count a category): phrases of the
    document, and the kind of its weightiest hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = worker_lexicon(ordinary)
        for batch in batches:
            keys, rows = [], []
            for text, rate, category in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                plain, words, same = lexicon.read(text)
                runs = [run for _, run in phrases(lexicon.hashed(same))]
                if kinds := {kind for _, _, kind, _ in lexicon._hits(plain, words, same)}:
                    runs.append(np.array([_key(max(kinds, key=lambda k: (WEIGHTS[k], k)))], dtype=np.uint64))
                made = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)
                keys.append(made)
                abusive = rate > 0.5
                rows.append([len(made), abusive, *(abusive and category == c for c in CATEGORIES)])
            counts = np.array([r[0] for r in rows], dtype=int)
            flags = np.repeat(np.array([r[1:] for r in rows], dtype=np.int64).reshape(len(rows), -1), counts, axis=0)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.ones(len(flat), dtype=np.int64)), *(pa.array(np.ascontiguousarray(f)) for f in flags.T)], ["key", "n", "abusive", *CATEGORIES])

    return run


def _named(ordinary, chosen) -> Callable:
    """(doc_id, text) to (key, phrase): the words of chosen phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = worker_lexicon(ordinary), set()
        for batch in batches:
            keys, names = [], []
            for text in batch.column(1).to_pylist():
                same = lexicon.read(text)[2]
                tokens = lexicon.tokens(same)
                for n, run_ in phrases(lexicon.hashed(same)):
                    for i in np.flatnonzero(np.isin(run_, chosen.value)).tolist():
                        if int(run_[i]) not in seen:
                            seen.add(int(run_[i]))
                            keys.append(run_[i])
                            names.append(" ".join(tokens[i : i + n]))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(names, pa.string())], ["key", "phrase"])

    return run


def reviewed(reviews: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, rate, category) of at most `labelled` reviewed documents, by a hash of the id: the part of reviews that call
    it abusive, without ties, and the category most of them name."""
    known = reviews.where("doc_id is not null and is_abusive in (0, 1)")
    counted = known.groupBy("doc_id").agg(F.avg("is_abusive").alias("rate"), F.mode(F.lower(F.trim("category")), True).alias("category"))
    return counted.where("rate <> 0.5").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)


def learned(documents: DataFrame, reviews: DataFrame, scratch, ordinary, labelled: int = LABELLED) -> Learned:
    """What the reviews of documents (doc_id, text) teach.  Reviews are (doc_id, is_abusive, category); nulls, ties and
    documents that are not there teach nothing, and without reviews the fixed weights hold."""
    sample = scratch.keep(reviewed(reviews, labelled))  # LABELLED rows at most, so it may be broadcast
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "rate", "category")
    size = sample.join(documents.select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rate") > 0.5).alias("abusive")).first()
    known = Learned()
    if not size.abusive or size.abusive == size.n:
        return known
    schema = ", ".join(f"{c} bigint" for c in ("key", "n", "abusive", *CATEGORIES))
    sums = rows.mapInArrow(_evidence(ordinary), schema).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "abusive", *CATEGORIES)])
    chance = size.abusive / size.n
    harmless = F.col("n") - F.col("abusive")
    ratio = 2 * (F.col("abusive") * F.log(F.col("abusive") / (F.col("n") * chance)) + F.when(harmless > 0, harmless * F.log(harmless / (F.col("n") * (1 - chance)))).otherwise(0.0))
    kinds = {_key(k) - (1 << 64 if _key(k) >> 63 else 0): k for k in WEIGHTS}
    telling = (F.col("abusive") >= PHRASE_LEAST) & (F.col("abusive") >= F.col("n") * PHRASE_PART) & (ratio >= LOG_RATIO)
    found = {}
    for r in sums.where(telling | F.col("key").isin(*kinds)).collect():  # phrases of a bounded sample
        if r.key in kinds:
            known.kinds[kinds[r.key]] = (PRIOR * WEIGHTS[kinds[r.key]] + r.abusive) / (PRIOR + r.n)
        else:
            found[r.key] = min(0.95, (r.abusive + 1) / (r.n + 2)), max(CATEGORIES, key=lambda c: r[c])
    if found:
        chosen = documents.sparkSession.sparkContext.broadcast(np.array([k % (1 << 64) for k in found], dtype=np.uint64))
        names = rows.select("doc_id", "text").mapInArrow(_named(ordinary, chosen), "key bigint, phrase string").distinct().collect()
        known.phrases = {r.phrase: found[r.key] for r in names}
        known.words = frozenset(w for p in known.phrases for w in p.split(" "))
    return known


def _scores(ordinary, known) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, taught = worker_lexicon(ordinary), Learned(*known.value)
        for batch in batches:
            made = [scored(lexicon, taught, text) for text in batch.column(2).to_pylist()]
            kinds = (pa.float64(), pa.float64(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds))], ["doc_id", "source", "score", "quoted_score", "category", "terms"])

    return run


def abuse_scores(documents: DataFrame, scratch, reviews: DataFrame | None = None, ordinary: tuple[str, ...] = ORDINARY) -> DataFrame:
    """(doc_id, source, score, quoted_score, category, terms) of every document.

    quoted_score is the part of the score that repeated messages alone would have;
    category is the one with the greatest weight, null without hits; terms are the
    distinct terms and phrases found.  `documents` is (doc_id, source, text), doc_id unique; other columns
    are ignored.  Null, empty and wordless texts score 0, texts of any length are read
    whole, an empty table has no scores; a null source stays null.  `reviews`: see `learned`.
    """
    context = documents.sparkSession.sparkContext
    words = context.broadcast(ordinary_words(ordinary))  # of files of a fixed size
    taught = learned(documents, reviews, scratch, words) if reviews is not None else Learned()
    known = context.broadcast((taught.kinds, taught.phrases, taught.words))  # plain values, which load wherever the package is; of a bounded sample
    rows = documents.select("doc_id", plain_source("source").alias("source"), "text")
    found = rows.mapInArrow(_scores(words, known), "doc_id bigint, source string, score double, quoted_score double, category string, terms array<string>")
    return found.withColumns({c: F.round(c, 6) for c in ("score", "quoted_score")})


def abuse_rates(scores: DataFrame) -> DataFrame:
    """Per source its documents, those that count as abusive, and their rate; documents without a source have a row of their own."""
    found = F.count_if(F.col("score") >= FOUND)
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), found.alias("abusive"), F.round(found / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
