"""Operator 8: language by cross-parsing entropy with suffix automata."""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, remainder, sample_ids, sample_rows, stored, table, whole_examples
from .textbatch import chunks

#: Training bound: labelled documents of each language, those with the smallest id hash, and their code points together. Documents are whole.
TRAIN_DOCS, TRAIN_CHARS = 64, 40_000
#: Texts are parsed in windows of so many codes side by side; what reaches over a window's end is then put right, so results do not depend on it.
WINDOW = 512
#: Rounds of putting right that are taken for all windows together, before the rest is done one by one.
ROUNDS = 3
SPACE, OTHER, FIRST = 0, 1, 3


class Alphabet:
    """Code points -> codes: one for anything but letters, one for letters not in `letters`, then the letters."""

    def __init__(self, letters: str):
        self.letters = letters
        self.kind = np.min_scalar_type(FIRST + len(letters))
        kinds = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.int8, 0x110000)
        self.runs = np.flatnonzero(np.diff(kinds, prepend=0, append=0)).reshape(-1, 2)  # of letters
        self.codes: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"codes": None}

    @property
    def size(self) -> int:
        return FIRST + len(self.letters)

    def encode(self, text: str) -> np.ndarray:
        """Lower-cased text as codes, runs of anything but letters as one space, none at the ends."""
        if self.codes is None:
            self.codes = np.full(0x110000, SPACE, self.kind)
            for a, b in self.runs.tolist():
                self.codes[a:b] = OTHER
            self.codes[[ord(x) for x in self.letters]] = np.arange(FIRST, self.size)
        c = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        keep = c != SPACE
        keep[1:] |= c[:-1] != SPACE
        if len(keep):
            keep[0] = c[0] != SPACE
        c = c[keep]
        return c[:-1] if len(c) and c[-1] == SPACE else c


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """The automaton that accepts the substrings of codes: transitions of each state, state 0 is the root."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def lay_out(nxt: list[dict[int, int]], size: int, offset: int) -> tuple[np.ndarray, int]:
    """The automaton as one sparse row of cells, and its root: a state is the number of a cell, its transition by code c lies c cells further on.

    A cell holds the state it belongs to (upper 32 bits) and the next state, both counted from `offset`; -1 if free. No two states have the same number. States
    with most transitions are placed first, each where its cells are free: the row is hardly longer than the transitions are many.
    """
    room = sum(map(len, nxt)) * 2 + 2 * size + len(nxt)
    used, taken, base = bytearray(room), bytearray(room), [0] * len(nxt)
    start = 0
    for s in sorted(range(len(nxt)), key=lambda s: -len(nxt[s])):
        codes = sorted(nxt[s])
        if not codes:
            base[s] = taken.find(0)
            taken[base[s]] = 1
            continue
        at, tries = max(start, codes[0]), 0
        while True:
            at = used.find(0, at)
            if at < 0 or at + size >= room:
                used.extend(bytes(room))
                taken.extend(bytes(room))
                room, at = 2 * room, room
            b = at - codes[0]
            if not taken[b] and not any(used[b + c] for c in codes):
                break
            at, tries = at + 1, tries + 1
        if tries > 32:
            start = at - 16
        base[s] = b
        taken[b] = 1
        for c in codes:
            used[b + c] = 1
    cells = np.full(max(max(base), used.rfind(1)) + size + 1, -1, np.int64)
    for s, d in enumerate(nxt):
        for c, to in d.items():
            cells[base[s] + c] = (base[s] + offset) << 32 | (base[to] + offset)
    return cells, base[0] + offset


class CrossParser:
    """Automata of all languages in one row of cells, with every language's first steps.

    A text is cut greedily: where a match cannot go on, the phrase ends and the symbol starts the next one; a symbol never seen is a phrase of its own.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        self.alphabet = Alphabet("".join(sorted({c for ts in texts.values() for t in ts for c in t.lower() if unicodedata.category(c)[0] == "L"})))
        size, rows, offset = self.alphabet.size, [], 0
        roots, self.cost = [], []
        self.first = np.full((len(self.langs), size), -1, np.int64)
        for k, lang in enumerate(self.langs):
            codes = np.concatenate([np.append(self.alphabet.encode(t), self.alphabet.kind.type(SPACE)) for t in texts[lang]] or [np.zeros(0, self.alphabet.kind)])
            cells, root = lay_out(suffix_automaton(codes), size, offset)
            at = root - offset + np.arange(size)
            here = cells[at] >> 32 == root
            self.first[k, here] = cells[at][here] & 0xFFFFFFFF
            rows.append(cells)
            roots.append(root)
            self.cost.append(math.log2(max(2, len(codes))))
            offset += len(cells)
        self.roots = np.array(roots, np.int64)
        self.cells = np.concatenate(rows) if rows else np.zeros(0, np.int64)

    def step(self, state: np.ndarray, code: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and phrases ended by the step. state (n,), code (n,) and lang (n,)."""
        e = self.cells[state + code]
        miss = np.flatnonzero((e >> 32) != state)
        e &= 0xFFFFFFFF
        ended = np.zeros(len(state), np.int64)
        new, root = self.first[lang[miss], code[miss]], self.roots[lang[miss]]
        unknown = new < 0
        ended[miss] = (state[miss] != root) + unknown.astype(np.int64)
        e[miss] = np.where(unknown, root, new)
        return e, ended

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases (texts, languages) of encoded texts, each cut as a whole.

        All windows of all texts are first cut side by side as if a phrase began with each. Then every window that the one before leaves with an open phrase is cut
        again from there, until both ways meet in one state, from where on they are the same. A window whose end has changed passes that on.
        """
        langs = len(self.langs)
        out = np.zeros((len(texts), langs), np.int64)
        n = np.array([len(t) for t in texts], np.int64)
        windows = -(-n // WINDOW)
        many = int(windows.sum())
        if not many or not langs:
            return out
        of = np.repeat(np.arange(len(texts)), windows)
        first = np.cumsum(windows) - windows
        flat = np.zeros(many * WINDOW, self.alphabet.kind)
        for at, t in zip(first.tolist(), texts, strict=True):
            flat[at * WINDOW : at * WINDOW + len(t)] = t
        grid = flat.reshape(many, WINDOW)
        width = np.full(many, WINDOW, np.int64)
        some = n > 0
        width[(first + windows - 1)[some]] = n[some] - (windows[some] - 1) * WINDOW
        order = np.argsort(-width, kind="stable")
        columns = np.ascontiguousarray(grid[order].T)
        live = np.searchsorted(-width[order], -np.arange(width.max()), side="left")  # windows with a symbol at each step
        state = np.repeat(self.roots[:, None], many, axis=1)
        count = np.zeros((langs, many), np.int64)
        lang = np.repeat(np.arange(langs)[:, None], many, axis=1)
        for t, m in enumerate(live.tolist()):
            code = np.broadcast_to(columns[t, :m].astype(np.int64), (langs, m)).reshape(-1)
            v, ended = self.step(state[:, :m].reshape(-1), code, lang[:, :m].reshape(-1))
            state[:, :m] = v.reshape(langs, m)
            count[:, :m] += ended.reshape(langs, m)
        back = np.empty(many, np.int64)
        back[order] = np.arange(many)
        end, count = state[:, back], count[:, back]
        start = np.repeat(self.roots[:, None], many, axis=1)
        later = np.flatnonzero(of[1:] == of[:-1]) + 1  # windows that continue a text
        for _ in range(ROUNDS):
            k, w = np.nonzero(end[:, later - 1] != start[:, later])
            if not len(k):
                break
            w = later[w]
            self.meet(grid, width, start, end, count, k, w, end[k, w - 1])
        for k, w in zip(*np.nonzero(end[:, later - 1] != start[:, later]), strict=True):
            w = later[w]
            while w < many and of[w] == of[w - 1] and end[k, w - 1] != start[k, w]:
                self.follow(grid, width, start, end, count, k, w)
                w += 1
        np.add.at(out, of, count.T)
        last = (first + windows - 1)[some]
        out[some] += (end[:, last] != self.roots[:, None]).T  # a phrase open at the text's end
        return out

    def meet(self, grid, width, start, end, count, k, w, new) -> None:
        """Windows w cut for languages k from the states `new`, beside their former way, until both meet or the window ends."""
        a, b = start[k, w], new.copy()
        start[k, w] = new
        for t in range(WINDOW):
            over = width[w] <= t
            if over.any():
                end[k[over], w[over]] = b[over]
            go = ~over & (a != b)
            if not go.all():
                k, w, a, b = k[go], w[go], a[go], b[go]
            if not len(k):
                return
            code = grid[w, t].astype(np.int64)
            a, x = self.step(a, code, k)
            b, y = self.step(b, code, k)
            count[k, w] += y - x
        end[k, w] = b

    def follow(self, grid, width, start, end, count, k: int, w: int) -> None:
        """As `meet`, for one window."""
        cells, first, root = self.cells, self.first[k], int(self.roots[k])
        a, b = int(start[k, w]), int(end[k, w - 1])
        start[k, w] = b

        def step(s, c):
            e = int(cells[s + c])
            if e >> 32 == s:
                return e & 0xFFFFFFFF, 0
            new = int(first[c])
            return (new, int(s != root)) if new >= 0 else (root, 1 + int(s != root))

        for c in grid[w, : width[w]].tolist():
            if a == b:
                return
            (a, x), (b, y) = step(a, c), step(b, c)
            count[k, w] += y - x
        end[k, w] = b

    def guess(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and bits a character; und, 0 and 0 without letters. Equal costs: the language that sorts first."""
        coded = [self.alphabet.encode(t) if t else np.zeros(0, self.alphabet.kind) for t in texts]
        lettered = np.array([bool((c != SPACE).any()) for c in coded], bool)
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        cost = self.phrases(coded) * np.array(self.cost)
        best = cost.argmin(axis=1)
        low = cost.min(axis=1)
        # the cost is a code length in bits: languages weigh 2**-(bits above the best), a tenth of each bit since phrases depend on each other
        share = 1 / np.exp2(-0.1 * (cost - low[:, None])).sum(axis=1)
        bits = low / np.maximum(1, [len(c) for c in coded])
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, share, 0.0).tolist(), np.where(lettered, bits, 0.0).tolist()


def learn_languages(labelled: DataFrame) -> CrossParser:
    """A parser from rows with doc_id, text and lang: of each language at most TRAIN_DOCS documents, those with the smallest
    id hash, as far as they have TRAIN_CHARS code points together; every document whole. That bounded sample is all that comes to the driver.
    Null texts, langs and ids are not learned from; of rows that repeat an id in a language one is. Without any row the parser knows no language."""
    d = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    ids = sample_ids(d, "lang", TRAIN_DOCS, "lang")
    sample = stored(sample_rows(d, ids, ["lang", "doc_id"], ["text"]).withColumn("n", F.char_length("text").cast("long")), "language-samples")
    texts: dict[str, list[str]] = {}
    for r in sorted(whole_examples(sample, "lang", "n", TRAIN_CHARS, "lang"), key=lambda r: (r["lang"], r["doc_id"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return CrossParser(texts)


def identify_language(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score, bits), or docs' columns in `keep` with lang_pred, score and bits behind them.

    Each whole text is cut greedily into the longest pieces that occur in a language's sample;
    pieces times the bits that point to a place in the sample are its cost there, and the lowest cost wins.
    Null, empty and letterless texts are und with score 0. A text in unknown letters still gets the cheapest
    language; of equal costs the one that sorts first. Repeated rows are judged each; without any learned language all are und; an empty table gives no rows.
    Very long texts are just more work. Columns of docs besides id, text and `keep` do not matter, whatever their names. The model travels once to each executor.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(parser)
    cols = [F.col(f"`{c}`") for c in keep] if keep else [F.col(id_col).alias("doc_id")]
    rows = docs.select(F.struct(*cols).alias("row"), F.col(text_col).alias("text"))

    def judged(batches):
        for b, texts in chunks(batches, most_bytes=1 << 20):
            lang, score, bits = model.value.guess(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=["row", "lang_pred", "score", "bits"])

    out = in_arrow(rows, judged, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, bits double")
    return out if keep else out.select("row.doc_id", "lang_pred", "score", "bits")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = learn_languages(docs.where(remainder(F.col("doc_id"), 3) != 1))
    return identify_language(docs, parser).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "bits")
