"""SentencePiece encoding and decoding with merge-type vocabularies."""

import gc
import heapq
import re
from hashlib import sha256
from itertools import chain

from pyspark.sql import DataFrame

from guestlens.functions.worker import worker_cached

# Words, and parts of words, whose ids a worker remembers: the newer half stays when a store is full.
REMEMBERED = 400_000

_SPACE = "▁"
# Cuts of a text: runs of letters and digits, runs of marks (raised digits count as such), each with the space marks
# before it, and line breaks; the same with letters and marks together; the whole text.
_PARTS = [
    re.compile(f"\n|{_SPACE}*(?:[^\\W_¹²³]+|(?:[^\\w{_SPACE}\n]|[_¹²³])+)|{_SPACE}+"),
    re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+"),
    re.compile(r".+", re.DOTALL),
]
# Parts up to this length are merged together, a round for all of them at a time.
_SHORT = 24


class Remembered:
    """A store of bounded size: the newer half stays when it is full. Values are tuples of
    numbers, which the garbage collector need not look at."""

    def __init__(self, size: int, longest: int = 64):
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.half, self.longest = size // 2, longest

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def keep(self, found: dict[str, tuple[int, ...]]) -> None:
        self.new.update((key, value) for key, value in found.items() if len(key) <= self.longest)
        if len(self.new) >= self.half:
            self.new, self.old = {}, self.new


class MergeEncoder:
    """Pieces of one merge-type model (no text normalisation, byte fallback)."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.vocab_size()
        merged = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in merged}
        self.cost = {lib.id_to_piece(i): -lib.get_score(i) for i in merged}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = lib.eos_id()
        # Where no piece spans two parts, nothing merges across their border, and each part
        # is encoded alone. The finest cut that holds for this vocabulary is taken.
        self.words = next(p for p in _PARTS if all(map(p.fullmatch, self.ids)))
        # A single space begins a part under every cut but the whole text.
        self.by_space = self.words is not _PARTS[-1]
        self.differing: set[str] = set()  # words for which the library gives other ids
        self.known = Remembered(remembered)
        self.known_parts = Remembered(remembered)
        self.names = [str(i) for i in range(size)]
        self.numbers = list(range(size))  # one object for each id, so that stored ids stay in the CPU's cache
        # what pieces show; a byte above 127 as the surrogate that stands for it
        self.shown = ["" if lib.is_control(i) else lib.id_to_piece(i) for i in range(size)]
        for b, i in enumerate(self.bytes):
            self.shown[i] = bytes([b]).decode("utf-8", "surrogateescape")
        self._tables(size)

    def _tables(self, size: int) -> None:
        """Symbols as numbers: a piece by its id, another character by size + code point;
        and all pairs of symbols that form a piece, sorted, with the piece and the rank of
        its score."""
        import numpy as np

        self.size, self.base = size, size + 0x110001
        self.of_char = np.arange(size, size + 0x110000, dtype=np.int32)
        singles = [(ord(piece), i) for piece, i in self.ids.items() if len(piece) == 1]
        self.of_char[[c for c, _ in singles]] = [i for _, i in singles]
        symbol = lambda s: self.ids.get(s, size + ord(s) if len(s) == 1 else None)
        costs = {c: rank for rank, c in enumerate(sorted(set(self.cost.values())))}
        pairs = []
        for piece, i in self.ids.items():
            for at in range(1, len(piece)):
                left, right = symbol(piece[:at]), symbol(piece[at:])
                if left is not None and right is not None:
                    pairs.append((left * self.base + right, i, costs[self.cost[piece]]))
        pairs = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_piece = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int32)
        self.pair_rank = np.r_[pairs[:, 2], len(costs)].astype(np.int32)  # the last: no piece

    def _pairs(self, left, right):
        """Places of the pairs among those that form a piece; one past the last for others."""
        import numpy as np

        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, at, len(self.pair_keys)) if len(self.pair_keys) else at

    def merge_short(self, parts: list[str]) -> list[tuple[int, ...]]:
        """Ids of parts of up to `_SHORT` characters, all merged together: a row holds the
        symbols of a part and its agenda, the ranks of the scores of all adjacent pairs.
        In each round every row joins the pair of its best score, the leftmost first, and
        ranks the two pairs of the new symbol; rows without a pair left are done."""
        import numpy as np

        width = max(map(len, parts))
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        codes = np.frombuffer("".join([p.ljust(width) for p in parts]).encode("utf-32-le"), dtype=np.uint32)
        symbols = self.of_char[codes.reshape(-1, width)]
        symbols[np.arange(width) >= lengths[:, None]] = -1  # joins with nothing
        pairs = self._pairs(symbols[:, :-1], symbols[:, 1:])
        ranks, none = self.pair_rank[pairs], self.pair_rank[-1]
        found: list[tuple[int, ...]] = [()] * len(parts)
        rows = np.arange(len(parts))

        def done(which):
            for row, length, final in zip(rows[which].tolist(), lengths[which].tolist(), symbols[which].tolist()):
                final = final[:length]
                if max(final) >= self.size:
                    final = chain.from_iterable((i,) if i < self.size else self.raw(i) for i in final)
                found[row] = tuple(map(self.numbers.__getitem__, final))

        while len(rows) and symbols.shape[1] > 1:
            all_rows = np.arange(len(rows))
            best = ranks.argmin(axis=1)
            ended = ranks[all_rows, best] == none
            if ended.any():
                done(ended)
                more = ~ended
                rows, lengths, symbols, pairs, ranks, best = (x[more] for x in (rows, lengths, symbols, pairs, ranks, best))
                if not len(rows):
                    break
                all_rows = np.arange(len(rows))
            symbols[all_rows, best] = self.pair_piece[pairs[all_rows, best]]
            columns = np.arange(symbols.shape[1])
            symbols = symbols[columns != best[:, None] + 1].reshape(len(rows), -1)
            lengths = lengths - 1
            other = columns[:-1] != best[:, None]
            pairs, ranks = pairs[other].reshape(len(rows), -1), ranks[other].reshape(len(rows), -1)
            for at in (best - 1, best):  # the pairs of the new symbol
                row = np.flatnonzero((at >= 0) & (at < pairs.shape[1]))
                at = at[row]
                pairs[row, at] = pair = self._pairs(symbols[row, at], symbols[row, at + 1])
                ranks[row, at] = self.pair_rank[pair]
        done(np.ones(len(rows), dtype=bool))
        return found

    def raw(self, symbol: int) -> list[int]:
        """Ids of the bytes of a character that is no piece."""
        return [self.bytes[b] for b in chr(symbol - self.size).encode()]

    def merge_long(self, part: str) -> tuple[int, ...]:
        """Ids of a part of any length. The agenda is a heap of the adjacent pairs that form
        a piece, by score, the leftmost first. The best is taken and joined unless one of
        its symbols has changed since, and the pairs that the new symbol forms with its
        neighbours join the agenda."""
        cost, symbols = self.cost, list(part)
        last = len(symbols)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        pairs = map(str.__add__, symbols, symbols[1:])
        agenda = [(cost[pair], left, pair) for left, pair in enumerate(pairs) if pair in cost]
        heapq.heapify(agenda)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            right = after[left]
            if right >= last or not symbols[left] or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            following = after[left] = after[right]
            if following < last:
                before[following] = left
                joined = pair + symbols[following]
                if joined in cost:
                    heapq.heappush(agenda, (cost[joined], left, joined))
            leading = before[left]
            if leading >= 0:
                joined = symbols[leading] + pair
                if joined in cost:
                    heapq.heappush(agenda, (cost[joined], leading, joined))
        numbers: list[int] = []
        for symbol in filter(None, symbols):
            number = self.ids.get(symbol)
            numbers += self.raw(self.size + ord(symbol)) if number is None else (number,)
        return tuple(numbers)

    def merge(self, parts: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of parts, over whose borders nothing merges."""
        short = [part for part in parts if len(part) <= _SHORT]
        short.sort(key=len)
        found = {part: self.merge_long(part) for part in parts if len(part) > _SHORT}
        for at in range(0, len(short), 4096):
            block = short[at : at + 4096]  # of like lengths
            found.update(zip(block, self.merge_short(block)))
        return found

    def parts_ids(self, parts: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of parts, from the store or merged."""
        new, old = self.known_parts.new, self.known_parts.old
        found = {part: new.get(part) or old.get(part) for part in parts}
        fresh = self.merge([part for part, ids in found.items() if ids is None])
        found.update(fresh)
        self.known_parts.keep({part: ids for part, ids in found.items() if part not in new})
        return found

    def words_ids(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of what stands between two single spaces, the space before it included. A word
        of letters is one part; others are cut, and what they begin with may be a word too.
        Words that are not in the store are compared with the library's ids of them."""
        new, old = self.known.new, self.known.old
        found = {word: old[word] for word in words if word in old}
        words = words - found.keys() if found else words
        cuts = {word: self.words.findall(_SPACE + word) for word in words if not word.isalpha()}
        begin = {word: cut[0][1:] for word, cut in cuts.items()}
        letters = {word for word in [*words, *begin.values()] if word.isalpha()}
        for word in letters:
            ids = new.get(word) or old.get(word)
            if ids is not None:
                found[word] = ids
        fresh = [word for word in letters if word not in found]
        merged = self.merge([_SPACE + word for word in fresh])
        found.update([(word, merged[_SPACE + word]) for word in fresh])
        parts = self.parts_ids({part for word, cut in cuts.items() for part in (cut[1:] if begin[word].isalpha() else cut)})
        for word, cut in cuts.items():
            first = found[begin[word]] if begin[word].isalpha() else parts[cut[0]]
            found[word] = tuple(chain(first, *[parts[part] for part in cut[1:]]))
        compared = [*fresh, *cuts]
        for word, right in zip(compared, self.library.encode(compared, num_threads=1)):
            if found[word] != tuple(right):
                self.differing.add(word)
        self.known.keep({word: ids for word, ids in found.items() if word not in new})
        return found

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """Ids of each text, and whether the library gives the same. What the stores don't
        know is merged together.

        A text whose words stand between single spaces is as right as its words, which are
        compared with the library when they are first met; the others are compared whole.
        """
        cuts = []
        for text in texts:
            # runs of spaces may form pieces of their own, so they stay with the word after them
            if self.by_space and text and "  " not in text and _SPACE not in text and text[0] != " " and text[-1] != " ":
                cuts.append((self.known, text.split(" ")))
            else:
                cuts.append((self.known_parts, self.words.findall(_SPACE + text.replace(" ", _SPACE)) if text else []))
        found = [list(map(store.new.get, cut)) for store, cut in cuts]
        words: set[str] = set()
        parts: set[str] = set()
        for (store, cut), ids in zip(cuts, found):
            if None in ids:
                (words if store is self.known else parts).update([unit for unit, i in zip(cut, ids) if i is None])
        fresh_words, fresh_parts = self.words_ids(words), self.parts_ids(parts)
        whole = [text for text, (store, _) in zip(texts, cuts) if store is not self.known]
        right = iter(self.library.encode(whole, add_eos=True, num_threads=1))
        out = []
        for (store, cut), ids in zip(cuts, found):
            if None in ids:
                now = fresh_words if store is self.known else fresh_parts
                ids = [now[unit] if i is None else i for unit, i in zip(cut, ids)]
            ids = [*chain.from_iterable(ids), self.end]
            agrees = ids == next(right) if store is not self.known else not self.differing or self.differing.isdisjoint(cut)
            out.append((ids, agrees))
        return out

    def text_of(self, ids: list[int]) -> str:
        """Decimal ids, joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, in UTF-8: the pieces one after the other, a byte piece being its
        byte, with spaces for their marks and without the one that encoding puts first."""
        text = "".join(map(self.shown.__getitem__, ids)).replace(_SPACE, " ")
        return text.removeprefix(" ").encode("utf-8", "surrogateescape")


def encoded(docs: DataFrame, model_path: str, doc_id: str, text: str, form: dict[str, str], row) -> DataFrame:
    """doc_id and the columns of `form`, made by row(encoder, ids, agrees) of
    every document, in small blocks of an Arrow batch."""
    with open(model_path, "rb") as file:  # a vocabulary, sent with the job
        model = file.read()
    name = sha256(model).hexdigest()
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *(f"{c} {kind}" for c, kind in form.items())])

    def encode(batches):
        gc.disable()  # it would look through the stores again and again; nothing here forms cycles
        try:
            yield from encode_all(batches)
        finally:
            gc.enable()

    def encode_all(batches):
        import pyarrow as pa

        encoder = worker_cached(("pieces", name), lambda: MergeEncoder(model))
        known = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
        names, kinds = ["doc_id", *form], [known[kind] for kind in form.values()]
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 64):
                block = [t or "" for t in batch.column(1).slice(at, 64).to_pylist()]
                rows += [row(encoder, ids, agrees) for ids, agrees in encoder.encode(block)]
            if rows:
                made = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.record_batch([batch.column(0), *made], names)

    return docs.select(doc_id, text).mapInArrow(encode, schema)


def encode_pieces(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, decoded, agrees.

    The ids come from a score-ordered agenda of adjacent symbol pairs, per part of a word,
    since no piece crosses its border; the new parts of a block of texts are merged together,
    those seen before are looked up in stores of bounded size.
    Every Arrow batch is checked against the sentencepiece library: words when a worker
    first meets them, texts with other white space than single spaces between words whole.
    `agrees` tells whether both gave the same ids; the agenda's are returned and decoded
    in any case.
    Encoding appends the end id and samples nothing. Decoding gives what the library's
    decode gives for these ids.

    A null text is empty and gives the end id alone. Repeated rows are rows of their own.
    An empty table gives no rows. Other columns are not looked at.
    """
    form = {"ids": "array<int>", "n_tokens": "long", "decoded": "string", "agrees": "boolean"}
    return encoded(docs, model_path, doc_id, text, form, lambda encoder, ids, agrees: (ids, len(ids), encoder.decode(ids).decode(), agrees))


def digest_pieces(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As `encode_pieces`, with digests in place of ids and decoded text, made where the
    ids are: doc_id, n_tokens, ids_sha256, decoded_sha256, agrees."""

    def digests(encoder, ids, agrees):
        shown = sha256(encoder.text_of(ids).encode()).hexdigest()
        return len(ids), shown, sha256(encoder.decode(ids)).hexdigest(), agrees

    form = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "agrees": "boolean"}
    return encoded(docs, model_path, doc_id, text, form, digests)
