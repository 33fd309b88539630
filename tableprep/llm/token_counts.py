"""Token counts of whole texts, as a public tokenizer gives them.

The tokenizer runs in Arrow functions, and only lengths come back. Texts are
cut at boundaries that no token crosses, the blanks before words. So a long
text never meets the tokenizer whole, work goes on in runs of about equal
bytes whatever texts they come from, and a word that occurs again in a run, or
that is among the lengths kept from earlier ones, is not encoded again.

The tokenizer's file is read by the driver and goes to the tasks with the
function, so executors need the library but not the file.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import arrow_schema, text_of

TOKEN_LIMIT = 2048
#: Characters of a stretch of text, or more up to the next safe boundary.
STRETCH = 1 << 16
#: Bytes of stretches that are worked on together, or one longer stretch.
RUN_BYTES = 1 << 20
#: Characters of words that are encoded as one text.
JOINED = 4000
#: Most lengths that are kept, of pieces of at most so many characters.
KEPT, KEPT_LENGTH = 1 << 19, 64

# The code points with the Unicode property White_Space.
SPACES = "".join(
    map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
#: A piece ends before a run of blanks; the run goes with the next piece.
BEFORE_BLANKS = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")
WORDS = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: For a library that itself puts a blank in front of each piece.
BETWEEN_WORDS = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
# Pre-tokenizers that end a token before a blank.
CUTTING = ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
#: The mark that stands for a blank in a piece's name.
MARK = chr(0x2581)


@dataclass(frozen=True)
class Tokens:
    """``lengths`` counts the tokens of pieces; ``boundary`` matches what may lie between pieces and ``words`` cuts at all of them; None: a text stays whole."""

    lengths: Callable[[list[str]], list[int]]
    boundary: re.Pattern[str] | None = None
    words: Callable[[str], list[str]] | None = None


def ends_before_blanks(config: dict) -> bool:
    """Whether no token of this file's tokenizer goes on from a character to a blank behind it.

    True of byte-level pre-tokenizers with their own pattern, of those that
    split at blanks, and of a pattern whose matches are the tokens if it
    matches blanks at the start of a token at most. No added token may hold or
    take in blanks. Any other file's texts are encoded whole.
    """
    for token in config.get("added_tokens") or ():
        if token["lstrip"] or token["rstrip"] or any(x in SPACES for x in token["content"]):
            return False
    kind = config.get("pre_tokenizer") or {}
    while kind.get("type") == "Sequence" and kind["pretokenizers"]:
        kind = kind["pretokenizers"][0]
    if kind.get("type") == "ByteLevel":
        return kind.get("use_regex", True)
    if kind.get("type") == "Split":
        pattern = (kind.get("pattern") or {}).get("Regex")
        return bool(pattern and kind.get("invert") and kind.get("behavior") == "Removed" and _never_crosses(pattern))
    return kind.get("type") in CUTTING


def _never_crosses(pattern: str) -> bool:
    """Whether no match goes from a character to a blank, tried on characters of every class."""
    import regex

    solid = [chr(x) for x in (0x61, 0x41, 0x31, 0x27, 0x2E, 0x5F, 0xE9, 0x4E2D, 0x301, 0x1F600)]
    probes = (f"{a}{b}{blank}{c}" for a in solid for b in solid for blank in (" ", "\n", "\t ") for c in solid)
    return not any(regex.search(f"[^{SPACES}][{SPACES}]", x) for probe in probes for x in regex.findall(pattern, probe))


def _from_json(content: bytes) -> Tokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(texts: list[str]) -> list[int]:
        """Words with a blank in front, encoded many at a time; a token counts for the word it starts in."""
        out = np.zeros(len(texts), np.int64)
        groups: list[list[int]] = [[]]
        alone, size = [], 0
        for i, text in enumerate(texts):
            if text[:1] not in SPACES or text[-1:] in SPACES:
                alone.append(i)
                continue
            if size > JOINED:
                groups.append([])
                size = 0
            groups[-1].append(i)
            size += len(text)
        out[alone] = whole([texts[i] for i in alone])
        together = ["".join(texts[i] for i in group) for group in groups]
        for group, found in zip(groups, tokenizer.encode_batch(together, add_special_tokens=False), strict=True):
            ends = np.cumsum([len(texts[i]) for i in group])
            starts = [start for start, _ in found.offsets]
            out[group] = np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(group))
        return out.tolist()

    if ends_before_blanks(json.loads(content)):
        return Tokens(joined, BEFORE_BLANKS, WORDS.findall)
    return Tokens(whole)


def _from_model(content: bytes) -> Tokens:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)

    def whole(texts: list[str]) -> list[int]:
        return [len(x) for x in model.encode(texts, add_bos=False, add_eos=False, num_threads=1)]

    # A blank is a mark in front of a word. Where no piece has the mark behind
    # another character and every text gets one in front, words stand alone.
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    alone = not any(MARK in name.lstrip(MARK) for name in names)
    prefixed = model.encode("a b") == model.encode("a") + model.encode("b")
    if alone and prefixed:
        return Tokens(whole, BETWEEN_WORDS, BETWEEN_WORDS.split)
    return Tokens(whole)


def load(name: str, content: bytes) -> Tokens:
    if name.endswith(".json"):
        return _from_json(content)
    if name.endswith(".model"):
        return _from_model(content)
    raise ValueError(f"{name}: a .json or .model file is wanted")


def stretches(text: str, boundary: re.Pattern[str] | None, size: int = STRETCH) -> Iterator[str]:
    """The text cut at boundaries, the first one behind each ``size`` characters; what a boundary matches goes."""
    start = 0
    while boundary and len(text) - start > size and (found := boundary.search(text, start + size)):
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def balanced(parts: Iterable[tuple[int, str]], most: int = RUN_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Runs of numbered stretches of at most ``most`` bytes, or one longer stretch."""
    run: list[tuple[int, str]] = []
    size = 0
    for part in parts:
        n = len(part[1].encode("utf-8", "replace"))
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(part)
        size += n
    if run:
        yield run


class TokenCounter:
    """Counts the tokens of texts; keeps the lengths of short pieces."""

    def __init__(self, tokens: Tokens, stretch: int = STRETCH, most: int = RUN_BYTES, kept: int = KEPT) -> None:
        self.tokens, self.stretch, self.most, self.kept = tokens, stretch, most, kept
        self.known: dict[str, int] = {"": 0}

    def counts(self, texts: Iterable[str]) -> list[int]:
        out: list[int] = []

        def numbered() -> Iterator[tuple[int, str]]:
            for i, text in enumerate(texts):
                out.append(0)
                for stretch in stretches(text, self.tokens.boundary, self.stretch):
                    yield i, stretch

        for run in balanced(numbered(), self.most):
            words = self.tokens.words or (lambda text: [text])
            parts = [(i, Counter(words(stretch))) for i, stretch in run]
            known = self.known
            new = list({x for _, part in parts for x in part if x not in known})
            found = dict(zip(new, self.tokens.lengths(new), strict=True)) if new else {}
            for i, part in parts:
                out[i] += sum(n * (known[x] if x in known else found[x]) for x, n in part.items())
            if len(known) + len(found) > self.kept:
                self.known = known = {"": 0}
            known.update((x, n) for x, n in found.items() if len(x) <= KEPT_LENGTH)
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    ``path`` is a file of the tokenizers library (.json) or of sentencepiece
    (.model), readable by the driver. Begin, end and other special tokens are
    not added; special strings inside a text are what the library takes them
    for by default; a limit or padding in the file is switched off. A null
    text is the empty one, without tokens. Repeated rows and rows without an
    id each give a row; no rows give none. A very long text is cut where no
    token crosses, and stays whole where it has no such place. Other columns
    are not read.
    """
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    out = arrow_schema(schema)
    with open(path, "rb") as file:
        content = file.read()
    name = os.path.basename(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or TokenCounter(load(name, content))
            found = counter.counts(x.as_py() for x in batch.column("text"))
            columns = [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64()),
                pa.array([n > limit for n in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    text = text_of()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return rows.mapInArrow(count, schema)
