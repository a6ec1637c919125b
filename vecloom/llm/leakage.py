"""Held-out passages that occur in a corpus.

Latent semantic retrieval. Every document is read as overlapping passages of 15 words
(blocks of five words, three to a passage: a run of 20 words always holds a whole one), each a TF-IDF
vector over the words of the held-out items (weight: the square of the inverse document
frequency's logarithm). A randomised SVD
gives the latent space: one pass over the whole corpus counts document frequencies and
multiplies the passages' Gram matrix with a random test matrix, partition by partition, and
the sums are added up; from an orthonormal basis of the weighted product and the small core
matrix that product and test matrix determine come the leading right singular vectors. A second pass projects the passages and takes as candidates all
pairs of document and item with a cosine of ``min_cosine`` or more in that space; an item has a
passage from every fifth of its words on. The bound is low, for misread words count as nothing. A passage
whose projection is shorter than ``INFORMATIVE`` times that of the item passage with the
shortest one holds too few of the items' words to be compared and is passed over.

Each candidate is then checked word by word. First a bound on the longest common subsequence of the
two passages: the document's words that the item has within ``BAND`` places of the same place; below
``MATCHED`` words no run with a few misread words is possible. Then:

 - the longest run of consecutive words of the item that the document holds, walked from every
   pair of neighbouring words that both share, where words broken at line ends are joined and
   misread letters are tolerated;
 - the longest common subsequence of the item and the stretch of the document around the
   passage, in words, and the answer check: how many of the item's ``ANSWER`` words of greatest
   weight the stretch holds.

The run decides for ``leaked_passages``; subsequence and answer check decide for paraphrases
(``paraphrased_passages``), which have no such run.

The items are the query set. They are sent to every task in blocks whose vocabulary and passages
are bounded (``VOCABULARY``, ``PASSAGES``), and compared some thousand passages at a time; there is one pass over the documents per block.

Nulls: null ids, documents or passages take no part; a text that is empty or too short holds
no item. Rows that share an id count once (the longest run of them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import spread

#: Different words, and passages, of the items that are sent to the tasks at once (unless one item alone has more).
VOCABULARY, PASSAGES = 20_000, 60_000
BLOCK, BLOCKS = 5, 3
#: Words of a passage, and from one passage of an item to the next.
PASSAGE, STEP = BLOCK * BLOCKS, 5
#: Passages of items, and of documents, that are compared at once.
COMPARED, ROWS = 8192, 1024
#: Places by which a common word may be off: half a step, and words that a line end breaks.
BAND = 4
#: Of a document's passage, and of it with a block on either side (which hold all of a run of 20 words around it), the words that
#: the item must have in their places, and the pairs of neighbours among them: what runs with up to 8 misread words have, less one.
MATCHED, MATCHED_AROUND, NEIGHBOURS = 6, 11, 3
#: Words of an item by which the answer check goes.
ANSWER = 5
RANK = 96
#: Columns of the test matrix beyond the rank.
OVERSAMPLE = 32
#: A document's passage takes part if its projection is so long, as a share of the shortest of an item passage.
INFORMATIVE = 0.3
#: The least cosine of a candidate, and of one that may be a paraphrase.
MIN_COSINE, PARAPHRASE = 0.42, 0.7

_BROKEN = re.compile(r"[-=¬‐­–][ \t]*\n\s*")
_ASCII_SIGNS = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace()))

# Letters and signs that are misread for one another, each written as the last of its group.
_MISREAD = [("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("0", "o"), ("1", "l"), ("i", "l"), ("!", "l"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("q", "g"), ("c", "e"), ("f", "t"), ("h", "b"), ("n", "u"), ("a", "o")]


def lines_of(text: str) -> list[str]:
    """The lines in lower case without signs; a word that a mark breaks at a line end is whole, on the first of the two lines."""
    text = _BROKEN.sub("", text.lower())
    if text.isascii():
        return text.encode().translate(None, _ASCII_SIGNS).decode().split("\n")
    for sign in set(text):
        if not (sign.isalnum() or sign.isspace()):
            text = text.replace(sign, "")
    return text.split("\n")


def _folded(word: str) -> str:
    for a, b in _MISREAD:
        word = word.replace(a, b)
    return word


def _distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    same = 0  # common ends do not count
    while same < len(a) and same < len(b) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    longest = max(len(a), len(b))
    if longest <= most or most < 2:
        return longest <= most
    if len(set(a) ^ set(b)) > 2 * most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


class Matcher:
    """Whether a word of a document is a word of an item, misread letters allowed. Remembers its answers, up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known: dict[tuple[str, str], bool] = {}
        self.folded: dict[str, str] = {}
        self.most = most

    def _fold(self, word: str) -> str:
        got = self.folded.get(word)
        if got is None:
            if len(self.folded) >= self.most:
                self.folded.clear()
            got = self.folded[word] = _folded(word)
        return got

    def __call__(self, item: str, doc: str) -> bool:
        if item == doc:
            return True
        if abs(len(item) - len(doc)) > 2:
            return False
        got = self.known.get((item, doc))
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            a, b = self._fold(item), self._fold(doc)
            n = len(item)
            got = a == b or _distance_within(a, b, 0 if n < 3 else 1 if n < 8 else 2)
            self.known[item, doc] = got
        return got


def longest_run(item: list[str], doc: list[str], at_line_end: set[int], same: Matcher, starts: dict[tuple[str, str], list[int]], tried: list[int] | None = None) -> int:
    """Most consecutive words of the item that the document holds.

    ``at_line_end``: places of words that a line ends after; each may be the first half of a broken
    word. ``starts``: places of each pair of neighbouring words in the item. ``tried``: the document's
    places to walk from (default: all), among them all with such a pair.
    """
    best, done = 0, set()
    n, m = len(item), len(doc)
    for j in range(m - 1) if tried is None else tried:
        for i in starts.get((doc[j], doc[j + 1]), ()):
            if (i, j) in done:
                continue
            left_i, left_j = i, j
            while left_i > 0 and left_j > 0:
                if same(item[left_i - 1], doc[left_j - 1]):
                    left_i, left_j = left_i - 1, left_j - 1
                elif left_j > 1 and left_j - 2 in at_line_end and same(item[left_i - 1], doc[left_j - 2] + doc[left_j - 1]):
                    left_i, left_j = left_i - 1, left_j - 2
                else:
                    break
            a, b = i, j
            while a < n and b < m:
                done.add((a, b))
                if same(item[a], doc[b]):
                    a, b = a + 1, b + 1
                elif b + 1 < m and b in at_line_end and same(item[a], doc[b] + doc[b + 1]):
                    a, b = a + 1, b + 2
                else:
                    break
            best = max(best, a - left_i)
    return best


def common_subsequence(item: list[str], doc: list[str]) -> int:
    """The length of the longest common subsequence, in words: the item's places are bits of one number."""
    places: dict[str, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    every = (1 << len(item)) - 1
    row = every
    for w in doc:
        if hit := places.get(w):
            x = row & hit
            row = ((row + x) | (row - x)) & every
    return len(item) - row.bit_count()


@dataclass
class _Items:
    """What the tasks need of one block of items."""

    ids: list[int]
    words: list[list[str]]
    vocabulary: dict[str, int]

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> _Items:
        ids, words, vocabulary = [], [], {}
        for item_id, passage in rows:
            tokens = " ".join(lines_of(passage)).split()
            if tokens:
                ids.append(item_id)
                words.append(tokens)
                for w in tokens:
                    vocabulary.setdefault(w, len(vocabulary))
        return _Items(ids, words, vocabulary)


def _doc_tokens(text: str, vocabulary: dict[str, int]) -> tuple[list[str], set[int]]:
    """The words of a document and the places of those that a line ends after; a word broken without a mark is joined if that makes a word of the vocabulary of two that are not both of it."""
    words: list[str] = []
    ends: set[int] = set()
    for line in lines_of(text):
        more = line.split()
        if not more:
            continue
        if words:
            whole = words[-1] + more[0]
            if whole in vocabulary and not (words[-1] in vocabulary and more[0] in vocabulary):
                words[-1] = whole
                words.extend(more[1:])
                continue
            ends.add(len(words) - 1)
        words.extend(more)
    return words, ends


def _coded(texts: list[str], vocabulary: dict[str, int]) -> tuple[list[tuple[list[str], set[int]]], np.ndarray, np.ndarray]:
    """Tokens per text; the codes of all (-1 outside the vocabulary, -2 padding) in whole blocks; the text of each block."""
    docs = [_doc_tokens(t, vocabulary) for t in texts]
    get = vocabulary.get
    codes: list[int] = []
    counts = np.empty(len(docs), "i8")
    for k, (words, _) in enumerate(docs):
        codes.extend([get(w, -1) for w in words])
        pad = -len(words) % BLOCK
        codes.extend([-2] * pad)
        counts[k] = (len(words) + pad) // BLOCK
    return docs, np.asarray(codes, "i4"), np.repeat(np.arange(len(docs)), counts)


def _test_matrix(size: int, rank: int) -> np.ndarray:
    return np.random.default_rng(20240301).standard_normal((size, rank)).astype("f4")


def _batched(batches: Iterator[pa.RecordBatch], size: int = 400) -> Iterator[tuple[list[int], list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _sketch(texts: DataFrame, items: _Items, rank: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Over the whole corpus: documents, document frequencies, and the Gram matrix of the passages' counts times the test matrix."""
    size = len(items.vocabulary)
    sent = texts.sparkSession.sparkContext.broadcast(items.vocabulary)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, omega = sent.value, np.vstack([_test_matrix(size, rank), np.zeros((2, rank), "f4")])  # codes -2 and -1
        total, df, product = 0, np.zeros(size, "i8"), np.zeros((size, rank), "f8")
        for ids, batch in _batched(batches):
            total += len(ids)
            _, codes, block_doc = _coded(batch, vocabulary)
            at = np.flatnonzero(codes >= 0)
            if not len(at):
                continue
            terms = codes[at]
            df += np.bincount(np.unique(block_doc[at // BLOCK].astype("i8") * size + terms) % size, minlength=size)
            passages = np.concatenate([codes, np.full(-len(codes) % PASSAGE, -2, "i4")]).reshape(-1, PASSAGE)
            rows = omega[passages[:, 0]]
            for k in range(1, PASSAGE):
                rows += omega[passages[:, k]]
            order = np.argsort(terms, kind="stable")
            sorted_terms, rows = terms[order], rows[at[order] // PASSAGE]
            heads = np.flatnonzero(np.diff(sorted_terms, prepend=-1))
            for term, begin, end in zip(sorted_terms[heads].tolist(), heads.tolist(), np.append(heads[1:], len(order)).tolist()):
                product[term] += rows[begin:end].sum(0)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % 4], pa.int32()), pa.array([total], pa.int64()), pa.array([df.tobytes()], pa.binary()), pa.array([product.tobytes()], pa.binary())], names=["slot", "total", "df", "product"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df, product = 0, np.zeros(size, "i8"), np.zeros(size * rank, "f8")
        for batch in batches:
            for t, d, p in zip(*(batch.column(c).to_pylist() for c in ("total", "df", "product"))):
                total, df, product = total + t, df + np.frombuffer(d, "i8"), product + np.frombuffer(p, "f8")
        yield pa.record_batch([pa.array([0], pa.int32()), pa.array([total], pa.int64()), pa.array([df.tobytes()], pa.binary()), pa.array([product.tobytes()], pa.binary())], names=["slot", "total", "df", "product"])

    kind = "slot int, total long, df binary, product binary"
    parts = texts.mapInArrow(partial, kind).repartition(4, "slot").mapInArrow(summed, kind).collect()  # four rows of a size set by the items
    sent.unpersist()
    return sum(r["total"] for r in parts), sum(np.frombuffer(r["df"], "i8") for r in parts), sum(np.frombuffer(r["product"], "f8") for r in parts).reshape(size, rank)


def _latent_space(texts: DataFrame, items: _Items, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The projection (words x rank), the words' weights included, and the weights."""
    size = len(items.vocabulary)
    width = max(1, min(rank + OVERSAMPLE, size))
    total, df, product = _sketch(texts, items, width)
    weights = np.log((1 + total) / (1 + df)) ** 2 + 1e-3
    # with A the weighted passages: A'A times the test matrix, which for the weighted words is the one drawn by their weights
    image, tested = weights[:, None] * product, _test_matrix(size, width) / weights[:, None]
    basis, _ = np.linalg.qr(image)
    core = (basis.T @ image) @ np.linalg.pinv(basis.T @ tested)
    _, turn = np.linalg.eigh((core + core.T) / 2)
    leading = basis @ turn[:, ::-1][:, : min(rank, width)]  # right singular vectors of A, greatest first
    return (weights[:, None] * leading).astype("f4"), weights


def _windows(codes: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The projection of the passage that begins at each block."""
    blocks = len(codes) // BLOCK
    table = np.vstack([projection, np.zeros((2, projection.shape[1]), "f4")])  # codes -2 and -1
    part = table[codes[0::BLOCK]]
    for k in range(1, BLOCK):
        part += table[codes[k::BLOCK]]
    whole = part.copy()
    for k in range(1, BLOCKS):
        whole[: blocks - k] += part[k:]
    return whole


class _Passages:
    """The items' passages: unit vectors, the item of each, and its words (codes) with a block and a band on either side."""

    def __init__(self, items: _Items, projection: np.ndarray, weights: np.ndarray):
        vectors, owners, around = [], [], []
        for k, words in enumerate(items.words):
            codes = np.array([items.vocabulary[w] for w in words], "i4")
            last = max(0, len(codes) - PASSAGE)
            padded = np.full(len(codes) + PASSAGE + 2 * (BLOCK + BAND), -3, "i4")
            padded[BLOCK + BAND :][: len(codes)] = codes
            for at in sorted({*range(0, last + 1, STEP), last}):
                vectors.append(projection[codes[at : at + PASSAGE]].sum(0))
                owners.append(k)
                around.append(padded[at : at + PASSAGE + 2 * (BLOCK + BAND)])
        vectors = np.asarray(vectors, "f4")
        norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
        self.unit, self.owner, self.around = vectors / norms[:, None], np.asarray(owners), np.asarray(around)
        self.least = INFORMATIVE * float(norms.min())
        self.words = len(items.vocabulary)
        codes = [np.array([items.vocabulary[w] for w in words], "i8") for words in items.words]
        self.pairs = np.unique(np.concatenate([c[:-1] * self.words + c[1:] for c in codes]))
        self.answers = [sorted(set(words), key=lambda w: (-weights[items.vocabulary[w]], w))[:ANSWER] for words in items.words]

    def paired(self, codes: np.ndarray) -> np.ndarray:
        """Whether each word and the next are neighbours in some item."""
        out = np.zeros(len(codes), bool)
        if len(self.pairs) and len(codes) > 1:
            pair = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1].astype("i8") * self.words + codes[1:], -1)
            out[:-1] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        return out

    def candidates(self, codes: np.ndarray, projection: np.ndarray, block_doc: np.ndarray, min_cosine: float) -> dict[tuple[int, int], tuple[float, int]]:
        """For each pair of document and item with passages that are near each other and share words in their places: the best cosine and the document's block."""
        part = _windows(codes, projection)
        norm = np.sqrt(np.einsum("ij,ij->i", part, part))
        width = PASSAGE + 2 * BLOCK
        words = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(BLOCK, -2, "i4"), codes, np.full(PASSAGE, -2, "i4")]), width)[::BLOCK]
        known = (words[:, BLOCK : BLOCK + PASSAGE] >= 0).sum(1)
        strong = np.flatnonzero((norm >= self.least) & (known >= MATCHED))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for at in range(0, len(strong), ROWS):
            some = strong[at : at + ROWS]
            x, own = part[some] / norm[some, None], words[some]
            for first in range(0, len(self.unit), COMPARED):
                cosine = x @ self.unit[first : first + COMPARED].T
                w, v = np.divmod(np.flatnonzero(cosine >= min_cosine), cosine.shape[1])
                values = cosine[w, v]
                for a in range(0, len(w), 65536):
                    ww, vv = w[a : a + 65536], v[a : a + 65536] + first
                    left, right = own[ww, BLOCK : BLOCK + PASSAGE], self.around[vv, BLOCK : BLOCK + PASSAGE + 2 * BAND]
                    hit = left == right[:, :PASSAGE]
                    for k in range(1, 2 * BAND + 1):
                        hit |= left == right[:, k : k + PASSAGE]
                    good = np.flatnonzero(hit.sum(1) >= MATCHED)
                    left, right = own[ww[good]], self.around[vv[good]]
                    hit, pairs = np.zeros(left.shape, bool), np.zeros(len(left), "i4")
                    for k in range(2 * BAND + 1):
                        equal = left == right[:, k : k + width]
                        hit |= equal
                        pairs += (equal[:, 1:] & equal[:, :-1]).sum(1, dtype="i4")
                    good = good[(hit.sum(1) >= MATCHED_AROUND) & (pairs >= NEIGHBOURS)]
                    blocks = some[ww[good]]
                    for pair in zip(block_doc[blocks].tolist(), self.owner[vv[good]].tolist(), values[a + good].tolist(), blocks.tolist()):
                        if pair[2] > best.get(pair[:2], (-1.0, 0))[0]:
                            best[pair[:2]] = pair[2:]
        return best


_CHECKED = "doc_id long, item_id long, words int, cosine float, common float, answer float"


def _leaks_of_block(texts: DataFrame, items: _Items, min_words: int, min_cosine: float, rank: int, min_common: float, min_answer: float) -> DataFrame:
    """Candidates that have a run of ``min_words``, or the common subsequence and the answer's words of a paraphrase."""
    if not items.ids:
        return texts.sparkSession.createDataFrame([], _CHECKED)
    projection, weights = _latent_space(texts, items, rank)
    sent = texts.sparkSession.sparkContext.broadcast((items, projection, _Passages(items, projection, weights)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, projection, passages = sent.value
        same = Matcher()
        places = []
        for words in items.words:
            starts: dict[tuple[str, str], list[int]] = {}
            for i in range(len(words) - 1):
                starts.setdefault((words[i], words[i + 1]), []).append(i)
            places.append(starts)
        for ids, batch in _batched(batches):
            docs, codes, block_doc = _coded(batch, items.vocabulary)
            if not len(block_doc):
                continue
            first_block = np.searchsorted(block_doc, np.arange(len(docs)))
            pairs = np.flatnonzero(passages.paired(codes))
            cuts = np.searchsorted(pairs, np.append(first_block, len(block_doc)) * BLOCK)
            tried: dict[int, list[int]] = {}
            out = []
            for (d, k), (cosine, block) in passages.candidates(codes, projection, block_doc, min_cosine).items():
                item, (words, ends) = items.words[k], docs[d]
                if d not in tried:
                    tried[d] = [j for j in (pairs[cuts[d] : cuts[d + 1]] - first_block[d] * BLOCK).tolist() if j < len(words) - 1]
                run = longest_run(item, words, ends, same, places[k], tried[d])
                at = (block - int(first_block[d])) * BLOCK
                stretch = words[max(0, at - len(item)) : at + len(item) + PASSAGE]
                common = common_subsequence(item, stretch) / len(item) if run >= min_words or cosine >= PARAPHRASE else 0.0
                answer = 0.0
                if common >= min_common:
                    held = set(stretch)
                    answer = sum(w in held for w in passages.answers[k]) / len(passages.answers[k])
                if run >= min_words or (common >= min_common and answer >= min_answer):
                    out.append((ids[d], items.ids[k], run, cosine, common, answer))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.float32(), pa.float32(), pa.float32()))], names=["doc_id", "item_id", "words", "cosine", "common", "answer"])

    return texts.mapInArrow(search, _CHECKED)


def _item_blocks(rows: Iterator) -> Iterator[_Items]:
    """The items in blocks of bounded vocabulary and number of passages."""
    block: list[tuple[int, str]] = []
    words: set[str] = set()
    passages = 0
    for r in rows:
        own = " ".join(lines_of(r["passage"])).split()
        if block and (len(words | set(own)) > VOCABULARY or passages + len(own) // STEP + 1 > PASSAGES):
            yield _Items.of(block)
            block, words, passages = [], set(), 0
        block.append((r["item_id"], r["passage"]))
        words.update(own)
        passages += len(own) // STEP + 1
    yield _Items.of(block)


def checked_candidates(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str, min_words: int = 20, min_cosine: float = MIN_COSINE, rank: int = RANK, min_common: float = 0.5, min_answer: float = 0.6) -> DataFrame:
    """``(doc_id, item_id, words, cosine, common, answer)``: leaked and paraphrased items of the documents, one row per pair: longest run in words, best cosine, share of the item that is a common subsequence, share of its answer's words."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and length(text) > 0")
    texts = spread(texts)
    queries = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(passage_col).cast("string").alias("passage")).where("item_id is not null and passage is not null").distinct()
    found = None
    for block in _item_blocks(queries.orderBy("item_id", "passage").toLocalIterator()):
        part = _leaks_of_block(texts, block, min_words, min_cosine, rank, min_common, min_answer)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("words", "cosine", "common", "answer")))


def leaked_passages(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str, min_words: int = 20, **how) -> DataFrame:
    """``(doc_id, item_id, words, cosine)``: the documents that hold at least ``min_words`` consecutive words of an item, with the longest run and the best cosine."""
    checked = checked_candidates(documents, id_col, text_col, items, item_col, passage_col, min_words, min_common=2.0, **how)
    return checked.select("doc_id", "item_id", "words", "cosine")


def paraphrased_passages(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str, min_words: int = 20, **how) -> DataFrame:
    """``(doc_id, item_id, words, cosine, common, answer)``: documents with no run of ``min_words`` words of an item, but with most of its words in their order (``min_common``) and of its answer's words (``min_answer``) in one stretch."""
    return checked_candidates(documents, id_col, text_col, items, item_col, passage_col, min_words, **how).where(F.col("words") < min_words)


def leaks_by_item(leaks: DataFrame, items: DataFrame, item_col: str) -> DataFrame:
    """``(item_id, docs)`` for every item, 0 if it did not leak."""
    counts = leaks.groupBy(F.col("item_id").alias("leaked")).agg(F.count("*").alias("docs"))
    every = items.select(F.col(item_col).cast("long").alias("item_id")).where("item_id is not null").distinct()
    return every.join(counts, F.col("item_id") == F.col("leaked"), "left").select("item_id", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"))
