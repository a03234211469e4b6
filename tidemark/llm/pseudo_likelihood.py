"""Score documents by masked pseudo-likelihood under a bidirectional window network trained here, in numpy.

The network knows the most frequent words of the corpus (up to `CLASSES * MEMBERS`). It predicts a token from the tokens
up to `WINDOW` places before and after it: embeddings, a matrix for each place, summed, tanh, and a softmax of two levels,
first the word's class, then the word among its class's members, so that a prediction costs classes plus members and not the vocabulary.
All other words are one class to the output, and hash buckets to the input; each is spelled by a model of bytes given the
two bytes before, learned from the rare words of the corpus, so every word has a probability of its own.
A document's score is the sum over all its tokens of the log-probability given both sides.

All documents count and teach. Words are counted over the whole corpus. Encoded documents are dealt by a hash of id and
text into lots of about `LOT_TOKENS` tokens, in a fixed order within each, and a lot is stored as one row: the unit of
training and of scoring. Each training round masks another part of the positions; from the same starting network every
lot trains its own, and these are averaged, weighted by targets, in sums of bounded blocks. So scores follow from the
rows alone, not from how the table is split (but for the last digits of sums), what is gathered grows with the corpus, and
the driver receives one network of bounded size.

Defined cases: a null, empty or blank text has no tokens and score 0; rows that repeat count as often as they occur;
a null id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import id_type, map_batches, numbered_copies, stored

WINDOW, CLASSES, MEMBERS, WIDTH = 2, 128, 128, 16
#: Hash buckets of rare words, as context; and of the two bytes before a byte, in spelling.
BUCKETS, CONTEXTS, SYMBOLS = 1023, 2048, 257
LOT_TOKENS = 1 << 21
#: Parameters in a block that is averaged over lots, and parts in which the lots are averaged first.
BLOCK, PARTS = 4096, 32
_PLACES = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]


@dataclass
class Network:
    """words: known words in order of frequency, as many as CLASSES * MEMBERS at most; ids after them are buckets, the last is a document's border."""

    words: list[str]
    embed: np.ndarray  # (vocabulary, WIDTH)
    places: np.ndarray  # (2 * WINDOW, WIDTH, WIDTH)
    classes: np.ndarray  # (WIDTH, CLASSES + 1); the last class is that of all rare words
    class_bias: np.ndarray  # (CLASSES + 1)
    members: np.ndarray  # (CLASSES, MEMBERS, WIDTH)
    member_bias: np.ndarray  # (CLASSES, MEMBERS)

    @property
    def border(self) -> int:
        return len(self.words) + BUCKETS

    @property
    def tables(self) -> list[np.ndarray]:
        return [self.embed, self.places, self.classes, self.class_bias, self.members, self.member_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.tables]).astype(np.float64)

    def with_flat(self, x: np.ndarray) -> Network:
        ends = np.cumsum([t.size for t in self.tables])
        return Network(self.words, *(p.reshape(t.shape).astype(np.float32) for p, t in zip(np.split(x, ends[:-1]), self.tables, strict=True)))

    def targets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and member of each id; rare words have the last class and no member (-1)."""
        known = ids < len(self.words)
        return np.where(known, ids // MEMBERS, CLASSES), np.where(known, ids % MEMBERS, -1)


def start(words: list[str], counts: np.ndarray, rare: float, seed: int) -> Network:
    """Small random embeddings; biases start at frequencies. counts: of the words; rare: of all others."""
    rng, n = np.random.default_rng(seed), len(words)
    each = np.zeros(CLASSES * MEMBERS)
    each[:n] = counts + 0.5
    each = each.reshape(CLASSES, MEMBERS)
    sums = np.append(each.sum(axis=1), rare + 0.5)
    with np.errstate(divide="ignore"):
        log = lambda x: np.maximum(np.log(x), -1e4).astype(np.float32)  # noqa: E731  places without a word never win
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        eye = np.stack([np.eye(WIDTH, dtype=np.float32)] * (2 * WINDOW))
        return Network(words, small(n + BUCKETS + 1, WIDTH), eye + small(2 * WINDOW, WIDTH, WIDTH), small(WIDTH, CLASSES + 1), log(sums / sums.sum()), small(CLASSES, MEMBERS, WIDTH), log(each / np.maximum(each.sum(axis=1, keepdims=True), 0.5)))


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Spelling:
    """Log-probabilities of words by bytes, each given a hash of the two before it; a word ends with a symbol of its own."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(CONTEXTS, SYMBOLS) + 0.01
        self.log = np.log(table / table.sum(axis=1, keepdims=True))

    @staticmethod
    def cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the flat table of all bytes and ends of the words, and the number of these in each word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        symbols = np.zeros(int(sizes.sum()), dtype=np.int64)
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(symbols), dtype=bool)
        inner[ends] = False
        symbols[inner] = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols[ends] = 256
        one, two = np.roll(symbols, 1), np.roll(symbols, 2)
        starts = ends - sizes + 1
        one[starts], two[starts] = 256, 256
        second = starts[sizes > 1] + 1
        two[second] = 256
        return (one * 31 + two * 1021) % CONTEXTS * SYMBOLS + symbols, sizes

    def __call__(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        cells, sizes = self.cells([w.encode("utf-8", "surrogatepass") for w in words])
        return np.add.reduceat(self.log.ravel()[cells], np.cumsum(sizes) - sizes)


class Tokens(dict):
    """Numbers by word: below `known` the id of a word, above it the place of a rare word in the lists kept here."""

    MOST = 500_000

    def __init__(self, words: list[str], spelling: Spelling):
        super().__init__({w: i for i, w in enumerate(words)})
        self.known, self.spelling = len(words), spelling
        self.rare: list[str] = []
        self.buckets, self.spelled = np.empty(0, dtype=np.int64), np.empty(0)

    def __missing__(self, word: str) -> int:
        self[word] = i = self.known + len(self.rare)
        self.rare.append(word)
        return i

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, float]]:
        """Ids (those of rare words are buckets) and the summed log-probability of the rare words' spelling, of each text."""
        found = [np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)) for words in map(split, texts)]
        fresh = self.rare[len(self.buckets) :]
        self.buckets = np.concatenate([self.buckets, [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in fresh]]).astype(np.int64)
        self.spelled = np.concatenate([self.spelled, self.spelling(fresh)])
        out = []
        for ids in found:
            rare = np.flatnonzero(ids >= self.known)
            at = ids[rare] - self.known
            ids[rare] = self.known + self.buckets[at]
            out.append((ids.astype("<u2"), float(self.spelled[at].sum())))
        if len(self.rare) > self.MOST:
            for w in self.rare:
                del self[w]
            self.rare, self.buckets, self.spelled = [], self.buckets[:0], self.spelled[:0]
        return out


def stream(ids: np.ndarray, sizes: np.ndarray, border: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of several texts with borders of WINDOW between them, the places of real tokens, and the text of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(ids)) + WINDOW * (owner + 1)
    out = np.full(len(ids) + WINDOW * (len(sizes) + 1), border, dtype=np.int32)
    out[at] = ids
    return out, at, owner


def placed(net: Network) -> np.ndarray:
    """The embeddings as each place sees them."""
    return np.stack([net.embed @ m for m in net.places])


def hidden(seen: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = seen[0][ids[at + _PLACES[0]]]
    for k, p in enumerate(_PLACES[1:], 1):
        h += seen[k][ids[at + p]]
    return np.tanh(h, out=h)


def log_softmax_at(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
    picked = scores[np.arange(len(own)), own].astype(np.float64)
    with np.errstate(over="ignore", divide="ignore"):
        total = np.log(np.exp(scores) @ np.ones(scores.shape[1], dtype=np.float32))
    if not np.isfinite(total).all():  # beyond what single precision holds
        most = scores.max(axis=1)
        total = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
    return picked - total


def by_class(cls: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each class with members that occurs, and the places where."""
    order = np.argsort(cls, kind="stable")
    ends = np.cumsum(np.bincount(cls, minlength=CLASSES + 1))
    for c in np.flatnonzero(np.diff(ends[:CLASSES], prepend=0)).tolist():
        yield c, order[ends[c - 1] if c else 0 : ends[c]]


def log_probabilities(net: Network, ids: np.ndarray, at: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Of the tokens at the places given, each from both sides; of a rare word that of being one."""
    out, seen = np.empty(len(at), dtype=np.float64), placed(net)
    for i in range(0, len(at), step):
        part = at[i : i + step]
        h = hidden(seen, ids, part)
        cls, member = net.targets(ids[part])
        found = np.empty(len(part))
        for j in range(0, len(part), 1024):  # so few that their scores stay near the processor
            scores = h[j : j + 1024] @ net.classes
            scores += net.class_bias
            found[j : j + 1024] = log_softmax_at(scores, cls[j : j + 1024])
        for c, rows in by_class(cls):
            for j in range(0, len(rows), 1024):
                some = rows[j : j + 1024]
                scores = h[some] @ net.members[c].T
                scores += net.member_bias[c]
                found[some] += log_softmax_at(scores, member[some])
        out[i : i + step] = found
    return out


class Trainer:
    """Adagrad on minibatches of masked positions."""

    def __init__(self, net: Network, rate: float = 0.5, batch: int = 2048):
        self.net, self.rate, self.batch, self.targets = net.with_flat(net.flat()), rate, batch, 0
        self.squares = [np.full_like(x, 1e-4) for x in self.net.tables]

    def learn(self, ids: np.ndarray, at: np.ndarray) -> None:
        for i in range(0, len(at), self.batch):
            self._step(ids, at[i : i + self.batch])
        self.targets += len(at)

    def gradients(self, ids: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the mean loss: for embed (only its rows that occur, given second), places, classes, class_bias, and for members
        and member_bias (only the classes that occur, given third)."""
        net, n = self.net, len(at)
        around = np.stack([ids[at + p] for p in _PLACES])
        seen = net.embed[around]
        h = np.tanh(np.einsum("pnw,pwv->nv", seen, net.places, optimize=True))
        cls, member = net.targets(ids[at])

        def error(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
            np.minimum(scores, 60, out=scores)
            np.exp(scores, out=scores)
            scores /= (scores.sum(axis=1, keepdims=True) + np.float32(1e-30)) * np.float32(n)
            scores[np.arange(len(own)), own] -= np.float32(1 / n)
            return scores

        p = error(h @ net.classes + net.class_bias, cls)
        back = p @ net.classes.T
        used, members, member_bias = [], [], []
        for c, rows in by_class(cls):
            q = error(h[rows] @ net.members[c].T + net.member_bias[c], member[rows])
            back[rows] += q @ net.members[c]
            used.append(c)
            members.append(q.T @ h[rows])
            member_bias.append(q.sum(axis=0))
        back *= 1 - h * h
        rows, where = np.unique(around, return_inverse=True)
        spread = np.stack([back @ m.T for m in net.places])
        cells = (where.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
        embed = np.bincount(cells, weights=spread.ravel(), minlength=len(rows) * WIDTH).reshape(-1, WIDTH).astype(np.float32)
        places = np.stack([x.T @ back for x in seen])
        shape = (0, MEMBERS, WIDTH)
        return [embed, places, h.T @ p, p.sum(axis=0), np.array(members, dtype=np.float32).reshape(-1, *shape[1:]), np.array(member_bias, dtype=np.float32).reshape(-1, MEMBERS)], rows, np.array(used, dtype=np.int64)

    def _step(self, ids: np.ndarray, at: np.ndarray) -> None:
        found, rows, used = self.gradients(ids, at)
        for x, g, s, some in zip(self.net.tables, found, self.squares, (rows, None, None, None, used, used), strict=True):
            if some is None:
                s += g * g
                x -= self.rate * g / np.sqrt(s)
            elif len(some):
                s[some] = t = s[some] + g * g
                x[some] -= self.rate * g / np.sqrt(t)


@dataclass
class Model:
    net: Network
    spelling: Spelling


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over the whole corpus; tasks count what they read, the shuffle adds up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                counts.update(split(t))
            if len(counts) > 500_000:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    rows = map_batches(docs.select(F.col(text_col).alias("text")), run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def untrained(counts: DataFrame, seed: int) -> tuple[Model, int]:
    """The starting network of a stored table of counts, the spelling of its rare words, and the number of tokens."""
    top = counts.orderBy(F.col("n").desc(), F.col("word")).limit(CLASSES * MEMBERS).collect()
    words, total = [r["word"] for r in top], counts.agg(F.sum("n")).first()[0] or 0
    shared = counts.sparkSession.sparkContext.broadcast(frozenset(words))  # CLASSES * MEMBERS at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(CONTEXTS * SYMBOLS, dtype=np.int64)
        for batch in batches:
            for i in range(0, len(batch), 20_000):
                some = [(w.encode("utf-8", "surrogatepass"), n) for w, n in zip(batch["word"][i : i + 20_000], batch["n"][i : i + 20_000], strict=True) if w not in shared.value]
                cells, sizes = Spelling.cells([w for w, _ in some])
                sums += np.bincount(cells, weights=np.repeat([n for _, n in some], sizes), minlength=len(sums)).astype(np.int64)
        there = np.flatnonzero(sums)
        yield pd.DataFrame({"cell": there, "n": sums[there]})

    cells = map_batches(counts, run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CONTEXTS * SYMBOLS at most
    table = np.zeros(CONTEXTS * SYMBOLS)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    known = np.array([r["n"] for r in top], dtype=np.float64)
    return Model(start(words, known, total - known.sum(), seed), Spelling(table)), total


def laid_out(docs: DataFrame, model: Model, tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(lot, names, sizes, spelled, ids): the encoded documents in lots, stored. tokens: how many there are, about.

    Rows that repeat (under one id, or under none) are numbered, and so spread over the lots, too.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.net.words, model.spelling))  # of bounded size
    lots = max(1, -(-tokens // LOT_TOKENS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known = Tokens(*shared.value)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                found = known.encode(part["text"].tolist())
                order = [xxhash.xxh64_intdigest(f"{h} {copy + 1}") >> 1 for h, copy in zip(part["hash"].tolist(), part["copy"].tolist(), strict=True)]
                yield pd.DataFrame({"lot": [x % lots for x in order], "place": order, "id": part["id"].to_numpy(), "spelled": [x for _, x in found], "ids": [x.tobytes() for x, _ in found]})

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "spelled"])
        sizes = [len(x) // 2 for x in rows["ids"]]
        return pd.DataFrame({"lot": rows["lot"].iloc[:1], "names": [rows["id"].tolist()], "sizes": [sizes], "spelled": [rows["spelled"].tolist()], "ids": [b"".join(rows["ids"])]})

    texts = numbered_copies(docs, id_col, text_col)[0].withColumn("hash", F.xxhash64("id", "text"))
    dealt = map_batches(texts, run, "lot long, place long, id string, spelled double, ids binary")
    return stored(dealt.groupBy("lot").applyInPandas(together, "lot long, names array<string>, sizes array<int>, spelled array<double>, ids binary"), "lots")


def averaged(rows: DataFrame, net: Network) -> Network | None:
    """The weighted mean of networks in blocks: rows (block, lot, weight, x). Each sum reads its rows one after another, in a fixed order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, weight, total = None, 0.0, np.empty(0)
        done = lambda: pd.DataFrame({"block": [key[0]], "part": [key[1]], "weight": [weight], "x": [(total / weight).astype("<f4").tobytes()]})
        for batch in batches:
            for block, part, w, x in zip(batch["block"], batch["part"], batch["weight"], batch["x"], strict=True):
                if key != (block, part):
                    if key:
                        yield done()
                    key, weight, total = (block, part), 0.0, np.zeros(len(x) // 4)
                weight += w
                total += w * np.frombuffer(x, dtype="<f4")
        if key:
            yield done()

    schema = "block int, part long, weight double, x binary"
    parts = map_batches(rows.withColumn("part", F.pmod("lot", F.lit(PARTS))).repartition("block", "part").sortWithinPartitions("block", "part", "lot").select("block", "part", "weight", "x"), run, schema)
    whole = parts.repartition("block").sortWithinPartitions("block", "part").select("block", F.lit(0).cast("long").alias("part"), "weight", "x")
    found = map_batches(whole, run, schema).collect()  # one network
    return net.with_flat(np.concatenate([np.frombuffer(r["x"], dtype="<f4") for r in sorted(found, key=lambda r: r["block"])])) if found else None


def train(lots: DataFrame, net: Network, rounds: int = 2, masked: float = 0.1, seed: int = 11) -> Network:
    """The network after some rounds over all lots; masked: the part of the positions that a round predicts, another one each round."""
    for turn in range(rounds):
        shared = lots.sparkSession.sparkContext.broadcast(net)  # of bounded size

        def run(batches: Iterator[pd.DataFrame], turn: int = turn, shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lot, sizes, content in zip(batch["lot"], batch["sizes"], batch["ids"], strict=True):
                    ids, at, _ = stream(np.frombuffer(content, dtype="<u2"), np.asarray(sizes, dtype=np.int64), shared.value.border)
                    draw = np.random.default_rng([seed, lot]).random(len(at))
                    at = at[(draw >= turn * masked) & (draw < (turn + 1) * masked)]
                    np.random.default_rng([seed, lot, turn]).shuffle(at)
                    trainer = Trainer(shared.value)
                    trainer.learn(ids, at)
                    if trainer.targets:
                        x = trainer.net.flat().astype("<f4")
                        blocks = [x[i : i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)]
                        yield pd.DataFrame({"block": range(len(blocks)), "lot": lot, "weight": float(trainer.targets), "x": blocks})

        net = averaged(map_batches(lots.select("lot", "sizes", "ids"), run, "block int, lot long, weight double, x binary"), net) or net
    return net


def score_lots(lots: DataFrame, net: Network, kind: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, pseudo_log_likelihood, per_token) of each document; kind: the type of the ids."""
    shared = lots.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for names, sizes, spelled, content in zip(batch["names"], batch["sizes"], batch["spelled"], batch["ids"], strict=True):
                n = np.asarray(sizes, dtype=np.int64)
                ids, at, owner = stream(np.frombuffer(content, dtype="<u2"), n, shared.value.border)
                total = np.bincount(owner, weights=log_probabilities(shared.value, ids, at), minlength=len(n)) + np.asarray(spelled)
                yield pd.DataFrame({"id": names, "n_tokens": n, "pseudo_log_likelihood": total, "per_token": total / np.maximum(n, 1)})

    rows = map_batches(lots.select("names", "sizes", "spelled", "ids"), run, "id string, n_tokens long, pseudo_log_likelihood double, per_token double")
    return rows.select(F.col("id").cast(kind).alias(id_col), *rows.columns[1:])


def _fit(docs: DataFrame, rounds: int, masked: float, seed: int, id_col: str | None, text_col: str) -> tuple[Model, DataFrame]:
    model, tokens = untrained(stored(word_counts(docs, text_col), "word-counts"), seed)
    rows = docs if id_col else docs.select(F.lit(0).alias("doc_id"), text_col)
    lots = laid_out(rows, model, tokens, id_col or "doc_id", text_col)
    return Model(train(lots, model.net, rounds, masked, seed), model.spelling), lots


def fit(docs: DataFrame, rounds: int = 2, masked: float = 0.1, seed: int = 11, id_col: str | None = None, text_col: str = "text") -> Model:
    """A model trained on all documents."""
    return _fit(docs, rounds, masked, seed, id_col, text_col)[0]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, pseudo_log_likelihood, per_token) of each row."""
    tokens = (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // 6
    return score_lots(laid_out(docs, model, tokens, id_col, text_col), model.net, id_type(docs, id_col), id_col)


def fit_and_score(docs: DataFrame, rounds: int = 2, masked: float = 0.1, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of the documents under a network trained on them; the texts are encoded once, and the lots stored."""
    model, lots = _fit(docs, rounds, masked, seed, id_col, text_col)
    return score_lots(lots, model.net, id_type(docs, id_col), id_col)
