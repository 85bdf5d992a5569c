"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A segmentation of a text is a path over its characters: pieces are edges, an edge's
weight is its piece's score, and two adjacent pieces join with weight 0 if merging
their characters gives exactly those two pieces, else with minus infinity. For
byte-pair vocabularies that leaves one path, the vocabulary's own encoding,
so the best path is exact and never tied.

A document longer than ``CHUNK`` characters is cut into chunks of that many characters,
wherever the cut falls. The state at a cut is the piece that covers the character before
it: how far it reaches back and ahead. A chunk yields its transfer matrix, the best
weight from every entry state to every exit state, from its own characters and a piece's
length of its neighbours'. Matrices combine associatively under (max, +), in blocks of
``FAN`` chunks and then over the blocks, which fixes the state at every cut. Each chunk is
then backtraced on its own between its two states.

Inside a chunk no piece spans the start of a word, so there all states fall into one:
matrices of ordinary text are a column, words and a row. Words are encoded once each and
remembered; the lattice itself runs over the broken words at the cuts and over words
longer than ``LONG_WORD``.

Characters outside the vocabulary become their UTF-8 byte pieces. Decoding is per chunk:
pieces to characters, byte pieces to bytes, the leading marker dropped.

Edge cases: a null or empty text has no pieces (one row, no ids). Spaces are kept, runs
included. Repeated rows and null ids are encoded row by row. Empty table: empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parked

CHUNK = 32_768
FAN = 256             # chunk matrices combined by one task
LONG_WORD = 64        # longer words go through the lattice
MEMO_WORDS = 600_000   # remembered encodings per task; the memo starts anew beyond
MEMO_PAIRS = 500_000
MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")
CUT = re.compile(f"(?<=[^{MARK}]){MARK}")
ENTRY = ""            # what comes before an entry state's piece
START = 0             # state before the first and after the last character
MATRIX = "row long, chunk long, entry int, exit int, weight double"
CHOSEN = "row long, chunk long, entry int, exit int"
ENCODED = "row long, doc_id long, chunk long, ids binary, weight double"


class Pieces:
    """A SentencePiece byte-pair vocabulary: scores, ids, join test."""

    def __init__(self, model_path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        m, n = self.model, self.model.get_piece_size()
        self.id = {m.id_to_piece(i): i for i in range(n)
                   if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        self.score = {p: m.get_score(i) for p, i in self.id.items()}
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.width = max(map(len, self.id))
        self.table = [m.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            self.table[i] = bytes([b])
        self.scores = np.array([m.get_score(i) for i in range(n)])
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bool] = {}
        self.joins: dict[tuple[str, str], bool] = {}

    def merged(self, s: str) -> list[str]:
        """Byte-pair merges of a short string: best score first, leftmost on ties."""
        parts = list(s)
        while True:
            best = max(((self.score[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score),
                       default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def edge(self, s: str) -> bool:
        """Whether s can be one piece (or one character outside the vocabulary)."""
        if len(s) == 1:
            return True
        if s not in self.score:
            return False
        if s not in self.known:
            self.known[s] = self.merged(s) == [s]
        return self.known[s]

    def join(self, a: str, b: str) -> bool:
        key = (a, b)
        found = self.joins.get(key)
        if found is None:
            if len(self.joins) >= MEMO_PAIRS:
                self.joins.clear()
            found = self.joins[key] = self.merged(a + b) == [a, b]
        return found

    def ids(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([self.id[p]] if p in self.id else [self.byte[b] for b in p.encode()])]

    def weight(self, part: str) -> float:
        return self.score.get(part, 0.0)

    def weight_of(self, ids: bytes) -> float:
        return float(self.scores[np.frombuffer(ids, "<u4")].sum())

    def encoded(self, words: list[list[str]]) -> list[bytes]:
        """Ids of lists of whole words (each from its marker to the next word).

        Words not yet known are encoded together; the memo starts anew when it is full."""
        new = set().union(*words).difference(self.words)
        if len(self.words) + len(new) > MEMO_WORDS:
            self.words = {}
            new = set().union(*words)
        short = [w for w in new if 1 < len(w) <= LONG_WORD]
        for w, ids in zip(short, self.model.encode([w[1:].replace(MARK, " ") for w in short], num_threads=1)):
            self.words[w] = array("I", ids).tobytes()
        for w in new.difference(short):
            path = Lattice(self, w, 0, len(w), [(START, None)]).path_to(START, len(w), None)[0]
            self.words[w] = array("I", self.ids(path)).tobytes()
        known = self.words.__getitem__
        return [b"".join(map(known, ws)) for ws in words]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Lattice:
    """Paths over s[begin:end] from entry states, as (position, last piece) -> entry -> weight.

    ``entries`` are (state, last piece or None); a state's path begins where its piece ends."""

    def __init__(self, pieces: Pieces, s: str, begin: int, end: int, entries: list[tuple[int, str | None]]):
        self.p, self.s = pieces, s
        self.at: list[dict] = [{} for _ in range(len(s) + 1)]  # position -> {last piece: {entry: (weight, previous)}}
        for state, piece in entries:
            self.at[begin + state % 32].setdefault(piece, {})[state] = (0.0, ENTRY)
        for x in range(begin, end):
            if self.at[x]:
                self.extend(x)

    def extend(self, x: int) -> None:
        """All pieces that begin at x, after every last piece they join."""
        for n in range(1, min(self.p.width, len(self.s) - x) + 1):
            piece = self.s[x:x + n]
            if not self.p.edge(piece):
                continue
            weight, into = self.p.weight(piece), self.at[x + n]
            for last, entries in self.at[x].items():
                if last is None or self.p.join(last, piece):
                    own = into.setdefault(piece, {})
                    for state, (w, _) in entries.items():
                        if state not in own or own[state][0] < w + weight:
                            own[state] = (w + weight, last)

    def path_to(self, state: int, x: int, piece: str | None) -> tuple[list[str], float]:
        """The best path of an entry state that ends at x (with the given last piece, if any)."""
        ends = self.at[x] if piece is None else {piece: self.at[x][piece]}
        piece = max((p for p in ends if state in ends[p]), key=lambda p: ends[p][state][0])
        weight, out = ends[piece][state][0], []
        while (last := self.at[x][piece][state][1]) != ENTRY:
            out.append(piece)
            x -= len(piece)
            piece = last
        return out[::-1], weight


def states_at(pieces: Pieces, s: str, cut: int) -> list[tuple[int, str]]:
    """Pieces that cover the character before the cut: (32 * reach back + reach ahead, piece)."""
    return [(32 * i + j, s[cut - i:cut + j])
            for i in range(1, min(pieces.width, cut) + 1) for j in range(min(pieces.width - i, len(s) - cut) + 1)
            if pieces.edge(s[cut - i:cut + j])]


class Chunk:
    """One chunk with its neighbours' nearest characters: s[begin:end] is its own."""

    def __init__(self, pieces: Pieces, s: str, begin: int, end: int, first: bool, last: bool):
        self.p, self.s, self.begin, self.end = pieces, s, begin, end
        self.entries = [(START, None)] if first else states_at(pieces, s, begin)
        self.exits = [(START, None)] if last else states_at(pieces, s, end)
        cuts = [m.start() for m in CUT.finditer(s, begin, end) if begin < m.start() < end]
        if first and s[begin:begin + 1] == MARK:
            cuts.insert(0, begin)
        self.head, self.tail = (cuts[0], cuts[-1]) if cuts else (None, None)
        if last and cuts:
            self.tail = end

    def words(self) -> list[str]:
        return WORD.findall(self.s, self.head, self.tail)

    def matrix(self) -> Iterator[tuple[int, int, float]]:
        """(entry, exit, weight) of every joinable pair of states; weights of the pieces that begin
        here. The whole words between head and tail are on every path, so their weight is
        left out of all entries alike."""
        if self.head is None:
            whole = Lattice(self.p, self.s, self.begin, self.end, self.entries)
            for state, _ in self.entries:
                for exit_, piece in self.exits:
                    w = self.best(whole, state, exit_, piece)
                    if w is not None:
                        yield state, exit_, w
            return
        head = Lattice(self.p, self.s[:self.head], self.begin, self.head, self.entries)
        tail = Lattice(self.p, self.s[self.tail:], 0, self.end - self.tail, [(START, None)])
        into = [(state, w) for state, _ in self.entries if (w := self.ending(head, state, self.head)) is not None]
        out = [(e, w) for e, piece in self.exits
               if (w := self.best(tail, START, e, piece, self.end - self.tail)) is not None]
        yield from ((i, o, a + b) for i, a in into for o, b in out)

    @staticmethod
    def ending(lattice: Lattice, state: int, x: int) -> float | None:
        return max((e[state][0] for e in lattice.at[x].values() if state in e), default=None)

    def best(self, lattice: Lattice, state: int, exit_: int, piece: str | None, end: int | None = None) -> float | None:
        end = self.end if end is None else end
        if piece is None:
            return self.ending(lattice, state, end)
        found = lattice.at[end + exit_ % 32].get(piece, {}).get(state)
        return None if found is None else found[0]

    def trace(self, entry: int, exit_: int, words: bytes | None = None) -> bytes:
        """Ids of the pieces that begin here on the path between the two states.

        ``words`` are the whole words' ids, if they are already encoded."""
        entries = [e for e in self.entries if e[0] == entry]
        piece = dict(self.exits)[exit_]
        u4 = lambda parts: array("I", self.p.ids(parts)).tobytes()
        if self.head is None:
            whole = Lattice(self.p, self.s, self.begin, self.end, entries)
            return u4(whole.path_to(entry, self.end + exit_ % 32, piece)[0])
        head = Lattice(self.p, self.s[:self.head], self.begin, self.head, entries)
        tail = Lattice(self.p, self.s[self.tail:], 0, self.end - self.tail, [(START, None)])
        a = head.path_to(entry, self.head, None)[0]
        b = tail.path_to(START, self.end - self.tail + exit_ % 32, piece)[0]
        if words is None:
            words = self.p.encoded([self.words()])[0]
        return u4(a) + words + u4(b)


Matrix = dict[tuple[int, int], float]


def product(a: Matrix, b: Matrix) -> Matrix:
    """(max, +) product: best weight over the state in between."""
    rows: dict[int, list[tuple[int, float]]] = {}
    for (m, o), w in b.items():
        rows.setdefault(m, []).append((o, w))
    out: Matrix = {}
    for (i, m), w in a.items():
        for o, x in rows.get(m, ()):
            if out.get((i, o), -np.inf) < w + x:
                out[i, o] = w + x
    return out


def resolve(matrices: list[Matrix], entry: int, exit_: int) -> list[tuple[int, int]]:
    """The states around every matrix on the best path from entry to exit (ties to the smaller state)."""
    best = [{entry: 0.0}]
    for m in matrices:
        step: dict[int, float] = {}
        for (i, o), w in m.items():
            if i in best[-1] and step.get(o, -np.inf) < best[-1][i] + w:
                step[o] = best[-1][i] + w
        best.append(step)
    out = []
    for m, before in zip(reversed(matrices), reversed(best[:-1])):
        state = min((-(before[i] + w), i) for (i, o), w in m.items() if o == exit_ and i in before)[1]
        out.append((state, exit_))
        exit_ = state
    return out[::-1]


def by_chunk(pdf: pd.DataFrame) -> tuple[list[int], list[Matrix]]:
    """Matrices of long-form rows, in order."""
    out: dict[int, Matrix] = {}
    for c, i, o, w in zip(pdf["chunk"].tolist(), pdf["entry"].tolist(), pdf["exit"].tolist(), pdf["weight"].tolist()):
        out.setdefault(c, {})[i, o] = w
    order = sorted(out)
    return order, [out[c] for c in order]


def block_matrix(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One block's chunk matrices, multiplied; ``chunk`` is the block's number."""
    _, matrices = by_chunk(pdf)
    total = matrices[0]
    for m in matrices[1:]:
        total = product(total, m)
    return pd.DataFrame([(key[0], key[1], i, o, w) for (i, o), w in total.items()],
                        columns=["row", "chunk", "entry", "exit", "weight"])


def block_states(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The states around every block of a document."""
    order, matrices = by_chunk(pdf)
    return pd.DataFrame([(key[0], c, i, o) for c, (i, o) in zip(order, resolve(matrices, START, START))],
                        columns=["row", "chunk", "entry", "exit"])


def chunk_states(key: tuple, pdf: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
    """The states around every chunk of a block whose outer states are known."""
    order, matrices = by_chunk(pdf)
    path = resolve(matrices, int(around["entry"].iloc[0]), int(around["exit"].iloc[0]))
    return pd.DataFrame([(key[0], c, i, o) for c, (i, o) in zip(order, path)], columns=["row", "chunk", "entry", "exit"])


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def encode_short(docs: DataFrame, model_path: str) -> DataFrame:
    """Documents of one chunk: a single pass of their words."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("ids", pa.binary()),
                        ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path)
        for batch in batches:
            rows, ids, texts = (c.to_pylist() for c in batch.columns)
            coded = pieces.encoded([WORD.findall(marked(t or "")) for t in texts]) if texts else []
            out = rows, ids, [0] * len(rows), coded, [pieces.weight_of(c) for c in coded]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return docs.select("row", "doc_id", "text").mapInArrow(run, ENCODED)


def cut_up(docs: DataFrame, chunk: int, margin: int) -> DataFrame:
    """Chunks of giant documents with ``margin`` characters of either neighbour."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, doc, text in zip(pdf["row"], pdf["doc_id"], pdf["text"]):
                s = marked(text)
                rows = []
                for c, b in enumerate(range(0, len(s), chunk)):
                    e = min(b + chunk, len(s))
                    rows.append((row, doc, c, s[max(0, b - margin):e + margin], min(b, margin), e - b, e == len(s)))
                    if len(rows) == 64 or e == len(s):
                        yield pd.DataFrame(rows, columns=["row", "doc_id", "chunk", "body", "lead", "size", "last"])
                        rows = []

    return docs.select("row", "doc_id", "text").mapInPandas(
        run, "row long, doc_id long, chunk long, body string, lead int, size int, last boolean")


def scan_states(chunks: DataFrame, model_path: str, fan: int) -> DataFrame:
    """The boundary states of every chunk, from transfer matrices combined associatively."""
    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(model_path)
        for pdf in batches:
            rows = [(r.row, r.chunk, i, o, float(w)) for r in pdf.itertuples()
                    for i, o, w in Chunk(pieces, r.body, r.lead, r.lead + r.size, r.chunk == 0, r.last).matrix()]
            yield pd.DataFrame(rows, columns=["row", "chunk", "entry", "exit", "weight"])

    each = parked(chunks.mapInPandas(matrices, MATRIX), "sp_matrices")
    by_block = each.groupBy("row", F.floor(F.col("chunk") / fan).alias("block"))
    blocks = by_block.applyInPandas(block_matrix, MATRIX)
    around = blocks.groupBy("row").applyInPandas(block_states, CHOSEN)
    return by_block.cogroup(around.groupBy("row", F.col("chunk").alias("block"))).applyInPandas(chunk_states, CHOSEN)


def encode_giant(docs: DataFrame, model_path: str, chunk: int, fan: int, margin: int) -> DataFrame:
    chunks = parked(cut_up(docs, chunk, margin).repartition("row", "chunk"), "sp_chunks")
    states = scan_states(chunks, model_path, fan)

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(model_path)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                ids = Chunk(pieces, r.body, r.lead, r.lead + r.size, r.chunk == 0, r.last).trace(r.entry, r.exit)
                rows.append((r.row, r.doc_id, r.chunk, ids, pieces.weight_of(ids)))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "chunk", "ids", "weight"])

    return chunks.join(states, ["row", "chunk"]).mapInPandas(traced, ENCODED)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
           fan: int = FAN, margin: int = 16) -> DataFrame:
    """``row``, ``doc_id``, ``chunk``, ``ids`` (little-endian unsigned 32-bit), ``weight`` per chunk.

    ``row`` numbers the input rows. ``chunk`` is at least four times ``margin``, the
    vocabulary's longest piece. ``model_path`` is the model file on the executors."""
    if chunk < 4 * margin or margin > 31:
        raise ValueError("chunks must hold four of the longest pieces, of at most 31 characters")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    giant = F.coalesce(F.char_length("text") >= chunk, F.lit(False))
    return encode_short(rows.where(~giant), model_path).unionByName(
        encode_giant(rows.where(giant), model_path, chunk, fan, margin))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with ``text``: every chunk's characters; chunk 0 without the leading marker."""
    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        pieces = Pieces(model_path)
        for chunk, ids in batches:
            yield pd.Series([pieces.decode(np.frombuffer(i, "<u4"))[int(c == 0):] for c, i in zip(chunk, ids)], dtype=object)

    return encoded.withColumn("text", text_of("chunk", "ids"))
