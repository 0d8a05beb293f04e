"""Abusive, hateful or sexual content (problem 8).

Method: a bidirectional gated recurrent network with attention pooling over
character and word inputs, trained in numpy; it scores every overlapping window
of a text, and a text scores as its highest window.

A word enters as its own vector (for words of the training vocabulary) plus the
mean vector of its hashed character trigrams, so misspelt and unseen words are
placed by their letters.  Before that the usual disguises are undone: full-width
and accented letters, invisible characters, digits and signs for letters,
letters spaced apart, repeated letters, masked letters.

The network is fitted on at most ``FIT_ROWS`` labelled examples, varied by
exchanging words of one class, on phrases composed from general lists and, as
background, on harmless examples into which words of a public tokenizer's
vocabulary are mixed; the rows to be scored take no part, so the fit is the same
at every size.  ``NETWORKS`` networks are fitted from different seeds, each in a
task of its own, and kept for later calls of the same process.

Windows start every ``STEP`` words and are scored by the first network; those at
``NEAR`` or more by all of them, whose mean is the window's score, and around
those below the threshold every window is scored.

Results: one row a document.  Null, empty and blank texts and texts without a
word score 0.  Very long texts are scored whole.  Repeated rows score alike.
"""

from __future__ import annotations

import base64
import os
import pickle
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import abuse_grammar as G
from weftgraph.llm.bpe import VOCABULARIES

WINDOW, STEP = 12, 6
DIM, HIDDEN, ATTENTION = 24, 14, 12
TRIGRAMS = 4096
#: Of the networks' mean.
THRESHOLD = 0.5
#: Networks whose mean decides.
NETWORKS = 3
#: Labelled rows used for fitting: those of the smallest key.
FIT_ROWS = 20_000
#: Windows of background in fitting; those drawn to find hard ones among them, and how many are kept a time.
BACKGROUND_WINDOWS = 9000
POOL_WINDOWS, HARD_WINDOWS = 60_000, 5000
#: The public vocabulary whose words the background holds.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Composed sentences, and variants of each abusive example.
COMPOSED, VARIANTS = 4500, 12
#: Score from which the windows between two steps are scored too.
NEAR = 0.05
EPOCHS, FIRST_EPOCHS = 6, 3
SEED = 11
PAD, NUMBER, UNKNOWN = 0, 1, 2

_TOKEN = re.compile(r"[一-鿿]|[^\W_](?:[\w@$*#!'’]*[\w@$*#])?|[@$*#]+\w+")
_SPACED = re.compile(r"(?<![\w'])[^\W\d_](?:[ .\-_]{1,3}[^\W\d_]){2,}(?!\w)")
_RUN = re.compile(r"(.)\1{2,}")
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "9": "g", "8": "b", "@": "a", "$": "s", "!": "i"})


def plain(text: str) -> str:
    """Lower case with compatibility forms, accents and invisible characters undone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join([c for c in text if c < "\x7f" or not (unicodedata.combining(c) or unicodedata.category(c) == "Cf")])
    text = text.lower()
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m[0]), text)
    return text


def reading(token: str) -> str:
    """A token without disguise; numbers are all alike."""
    if token.isalpha() and token.isascii():
        return _RUN.sub(r"\1", token) if len(token) > 3 else token
    t = token.strip("'’!")
    if not token:
        return ""
    if not t or t[0].isdigit() and not any(c.isalpha() for c in t):
        return "0"
    if any(c in "0134579@$!8" for c in t) and sum(c.isalpha() for c in t) >= 2 and not re.fullmatch(r"\d+\w|q\d|\w\d+", t):
        t = t.translate(_SIGNS)
    return _RUN.sub(r"\1", t)


@lru_cache(maxsize=200_000)
def trigrams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + 3].encode()) % TRIGRAMS for i in range(max(1, len(w) - 2))]


def words_of(text: str) -> list[str]:
    return [reading(t) for t in _TOKEN.findall(plain(text))]


# --- training --------------------------------------------------------------------------------


class Model:
    """The network's weights (numpy arrays) and its vocabulary."""

    def __init__(self, vocabulary: dict[str, int], weights: dict, keys: dict[str, str]):
        self.vocabulary = vocabulary
        self.weights = weights
        #: Deletion variants of the training words that mark abuse, for slips and masks.
        self.keys = keys
        self.cache: dict[str, int] = {}
        self.rows: list = []

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "weights": self.weights, "keys": self.keys}

    def __setstate__(self, s):
        self.__init__(s["vocabulary"], s["weights"], s["keys"])

    def canonical(self, word: str) -> str:
        """The training word that a slip or a mask most likely hides."""
        if word in self.vocabulary or len(word) < 4 or not word[0].isascii():
            return word
        return next((self.keys[k] for k in _variants(word) if k in self.keys), word)

    def vector(self, word: str):
        w = self.weights
        word = self.canonical(word)
        if word in ("", "0"):
            return w["E"][NUMBER if word else PAD]
        return w["E"][self.vocabulary.get(word, UNKNOWN)] + w["C"][trigrams(word)].mean(axis=0)


def _variants(word: str) -> list[str]:
    """The word with one letter (or one masked run) replaced by a gap, and with none."""
    bare = re.sub(r"[*#@$]+", "?", word)
    if "?" in bare:
        return [bare]
    return [word, *[word[:i] + word[i + 1 :] for i in range(len(word))]]


def _slips(word: str) -> list[str]:
    """Keys under which slips and masks of ``word`` are found: its own deletions and masks."""
    n = len(word)
    masks = [word[:i] + "?" + word[j:] for i in range(1, n - 1) for j in range(i + 1, min(n, i + 4))] + [word[:i] + "?" + word[j:k] + "?" + word[k + 1 :] for i in range(1, n - 2) for j in (i + 1,) for k in range(j + 1, n)]
    return [word[:i] + word[i + 1 :] for i in range(n)] + masks


def _sigmoid(x):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-x))


def _directions(w, x, keep: bool):
    """Hidden states of both directions over windows x (n, steps, dim)."""
    import numpy as np

    n, steps, _ = x.shape
    out, memo = [], []
    for d in "fb":
        h = np.zeros((n, HIDDEN), np.float32)
        hs = np.empty((n, steps, HIDDEN), np.float32)
        xw = x @ w["W" + d] + w["b" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = _sigmoid(xw[:, t, : 2 * HIDDEN] + h @ w["U" + d][:, : 2 * HIDDEN])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            hu = h @ w["U" + d][:, 2 * HIDDEN :]
            c = np.tanh(xw[:, t, 2 * HIDDEN :] + r * hu)
            new = z * h + (1 - z) * c
            if keep:
                memo.append((d, t, h, r, z, hu, c))
            h = new
            hs[:, t] = h
        out.append(hs)
    return np.concatenate(out, axis=2), memo


def _forward(w, x, mask, keep=False):
    import numpy as np

    hs, memo = _directions(w, x, keep)
    a = np.tanh(hs @ w["A"])
    s = a @ w["v"] + mask
    s = np.exp(s - s.max(axis=1, keepdims=True))
    p = s / s.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", p, hs)
    return pooled @ w["o"] + w["q"][0], (hs, memo, a, p, pooled)


def _step(w, words, tri, tri_n, y, wt):
    """Loss gradients of one batch."""
    import numpy as np

    emb = w["E"][words] + (w["C"][tri] * (tri >= 0)[..., None]).sum(axis=2) / tri_n[..., None]
    mask = np.where(words == PAD, np.float32(-30), np.float32(0))
    logit, (hs, memo, a, p, pooled) = _forward(w, emb, mask, True)
    g = {k: np.zeros_like(v) for k, v in w.items() if k not in "EC"}
    dl = ((_sigmoid(logit) - y) * wt / len(y)).astype(np.float32)
    g["o"], g["q"][0] = pooled.T @ dl, dl.sum()
    dp_pool = dl[:, None] * w["o"]
    dhs = p[..., None] * dp_pool[:, None, :]
    dp = np.einsum("nh,nth->nt", dp_pool, hs)
    ds = p * (dp - (dp * p).sum(axis=1, keepdims=True))
    g["v"] = np.einsum("nt,nta->a", ds, a)
    da = ds[..., None] * w["v"] * (1 - a * a)
    g["A"] = np.einsum("nth,nta->ha", hs, da)
    dhs += da @ w["A"].T
    dx = np.zeros_like(emb)
    carry = {"f": 0.0, "b": 0.0}
    for d, t, h, r, z, hu, c in reversed(memo):
        at = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
        dh = dhs[:, t, at] + carry[d]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * hu * r * (1 - r)
        du = np.concatenate([dr, dz, dc * r], axis=1)
        dg = np.concatenate([dr, dz, dc], axis=1)
        g["U" + d] += h.T @ du
        g["W" + d] += emb[:, t].T @ dg
        g["b" + d] += dg.sum(axis=0)
        dx[:, t] += dg @ w["W" + d].T
        carry[d] = dh * z + du @ w["U" + d].T
    return g, dx


def listed_words() -> set[str]:
    """Words of the lists of abuse."""
    return {x for c in (*G.CLASSES, G.VERMIN, G.ZH) for s in c for x in words_of(s)}


def grammar_words() -> set[str]:
    return listed_words() | {x for c in (G.INSULTS, G.THREATS, G.HATE, G.SEXUAL, G.OTHER) for s in c for x in words_of(re.sub(r"\{.\}", " ", s))}


def vocabulary_words(folder: str) -> list[str]:
    """Whole words of a public multilingual vocabulary, commonest first; none where the file is missing."""
    path = os.path.join(folder, VOCABULARY)
    if not os.path.exists(path):
        return []
    out: dict[str, None] = {}
    with open(path, "rb") as f:
        for line in f:
            try:
                w = base64.b64decode(line.split()[0]).decode()
            except (UnicodeDecodeError, IndexError):
                continue
            bare = w.strip().lower()
            if bare.isalpha() and (_TOKEN.fullmatch(bare[0]) and not bare[0].isascii() and "一" <= bare[0] <= "鿿" or w[0] == " " and len(bare) > 2):
                out[bare] = None
    return list(out)


def common_han() -> list[str]:
    """The commoner half of the characters of the GB 2312 standard, from their places in it."""
    out = []
    for row in range(0xB0, 0xD8):
        for at in range(0xA1, 0xFF):
            try:
                out.append(bytes([row, at]).decode("gb2312"))
            except UnicodeDecodeError:
                continue
    return out


def _compose(harmless_texts: list[str], passages: list[str], rng: random.Random, public: list[str], pool: int) -> tuple[list[tuple[list[str], int, float]], list[list[str]]]:
    """Training windows (words, label, weight), and a pool of further harmless windows."""
    sentences: list[tuple[list[str], int]] = []
    harmless = [words_of(s) for s in G.HARMLESS]
    clean: list[list[str]] = [words_of(s) for s in harmless_texts]
    clean = [s for s in clean if s]

    def disguised(s: str) -> list[str]:
        if rng.random() < 0.45:
            w = s.split(" ")
            for _ in range(rng.choice((1, 1, 2))):
                i = max(range(len(w)), key=lambda i: len(w[i]) * rng.random())
                w[i] = G.disguise(w[i], rng)
            s = " ".join(w)
        return words_of(s)

    sentences += [(disguised(G.sentence(rng)), 1) for _ in range(COMPOSED)]
    counts: dict[str, list[int]] = {}
    for w, _ in sentences:
        for x in w:
            counts.setdefault(x, [0, 0])[1] += 1
    for w in [*clean, *harmless]:
        for x in w:
            counts.setdefault(x, [0, 0])[0] += 1
    lists = listed_words()
    telling = lists | {x for x, (n, p) in counts.items() if p >= 10 and p > 5 * n and len(x) > 2}
    spare = [w for w in public if w not in telling] or [x for s in clean for x in s if len(x) > 3]
    signs = common_han()
    latin, han = [w for w in spare if w[0] < "一"], [w for w in spare if w[0] >= "一"]

    def odd_word() -> list[str]:
        if han and rng.random() < 0.12:
            return list(rng.choice(han))
        if latin and rng.random() < 0.8:
            return [latin[int(len(latin) * rng.random() ** 2)]]
        if rng.random() < 0.25:
            return ["0"]
        piece = lambda: rng.choice("bdfghjklmnprstvwz") + rng.choice("aeiou") + rng.choice(["", "", "l", "n", "r", "s", "m", "rt", "ng"])
        return ["".join(piece() for _ in range(rng.randint(2, 4))) + rng.choice(["", "", "", "s", "ing", "ed", "ly", "ation"])]

    for s in passages:
        sentences.append((words_of(s), 1))
        # Words that no list has may stand there by chance: they are exchanged at times, so that the rest tells.
        for _ in range(VARIANTS):
            w = disguised(G.varied(plain(s), rng))
            sentences.append(([y for x in w for y in (odd_word() if x not in lists and len(x) > 3 and rng.random() < 0.25 else [x])], 1))
    sentences = [(w, y) for w, y in sentences if w]

    chinese = [s for s in clean if sum("一" <= x[0] <= "鿿" for x in s) > len(s) / 2]

    def script(n: int) -> list[str]:
        """Harmless Chinese."""
        got: list[str] = []
        while len(got) < n:
            how = rng.random()
            got += rng.choice(chinese) if chinese and how < 0.25 else list(rng.choice(han)) if how < 0.6 else [rng.choice(signs) for _ in range(rng.randint(1, 4))] if how < 0.96 else odd_word()
        at = rng.randint(0, len(got) - n)
        return got[at : at + n]

    def around(w: list[str], n: int) -> list[str]:
        """Context in the passage's script."""
        return script(n) if han and w and "一" <= w[0][0] <= "鿿" and rng.random() < 0.8 else business(n)

    def business(n: int, odd: float = 0.15) -> list[str]:
        got: list[str] = []
        while len(got) < n:
            s = rng.choice(clean) if clean and rng.random() < 0.9 else rng.choice(harmless)
            if rng.random() < 0.25:
                got += words_of(rng.choice(G.GREETINGS))
            if rng.random() < 0.05:
                got += words_of(rng.choice(G.CLOSERS))
            for x in s:
                got += odd_word() if rng.random() < odd and len(x) > 3 else [x]
        at = rng.randint(0, len(got) - n)
        return got[at : at + n]

    out: list[tuple[list[str], int, float]] = []
    for w, y in sentences:
        room = WINDOW - len(w)
        if room > 0:
            a = rng.randint(0, room) if rng.random() < 0.75 else room
            use = [*(around(w, a) if a else []), *w, *(around(w, room - a) if room > a and rng.random() < 0.85 else [])]
        else:
            at = rng.randint(0, -room)
            use = w[at : at + WINDOW]
        out.append((use, y, 1.0))
    for _ in range(int(1.6 * len(sentences))):
        n = WINDOW if rng.random() < 0.9 else rng.randint(1, WINDOW)
        out.append((business(n), 0, 1.0))
    for s in harmless * 14:
        room = WINDOW - len(s)
        a = rng.randint(0, max(0, room))
        s = [y for x in s for y in (odd_word() if rng.random() < 0.1 and len(x) > 4 else [x])]
        opener = words_of(rng.choice(G.GREETINGS))
        out.append(([*(business(a) if a else opener), *s, *(business(room - a) if room > a else [])][:WINDOW], 0, 1.0))

    def background() -> list[str]:
        how = rng.random()
        got: list[str] = []
        if how < 0.3 and han:
            got = script(WINDOW)
        elif how < 0.4:  # words without a sentence
            while len(got) < WINDOW:
                got += odd_word()
        elif how < 0.55:  # cells of a table, fields of a record
            mark = rng.choice([["td", "td"], ["td"], ["th", "th"], ["tr", "td"], ["entity"], ["relationship"], []])
            while len(got) < WINDOW:
                got += [*mark, *(business(rng.randint(1, 4), 0.5) if rng.random() < 0.6 else odd_word())]
        else:
            got = business(WINDOW, rng.choice((0.2, 0.4, 0.7)))
        return got[:WINDOW]

    out += [(background(), 0, 1.0) for _ in range(BACKGROUND_WINDOWS)]
    rng.shuffle(out)
    return out, [background() for _ in range(pool)]


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?。！？…])\s+|\n+|(?<=[。！？])", text) if s.strip()]


def train(examples: list[tuple[str, int]], folder: str = VOCABULARIES, seed: int = SEED, public: list[str] | None = None) -> Model:
    """Fit the network on (text, label) examples, composed phrases and background.

    Only a passage of an abusive example is abusive.  A first network, fitted
    without those examples, picks the passage; the other sentences are harmless.
    """
    import numpy as np

    public = vocabulary_words(folder) if public is None else public
    harmless = [s for t, y in examples if not y for s in _sentences(t)]
    parts = [p for p in (_sentences(t) for t, y in examples if y) if p]
    first = Scorer(_fit(*_compose(harmless, [], random.Random(seed), public, POOL_WINDOWS), seed, FIRST_EPOCHS))
    picked = [int(np.argmax(first.score(p))) for p in parts]
    passages = [first.passage(p[i]) for p, i in zip(parts, picked)]
    harmless += [s for p, i in zip(parts, picked) for j, s in enumerate(p) if j != i]
    return _fit(*_compose(harmless, passages, random.Random(seed), public, POOL_WINDOWS), seed, EPOCHS)


def _fit(data: list[tuple[list[str], int, float]], pool: list[list[str]], seed: int, epochs: int) -> Model:
    """The network fitted on windows; ``pool`` holds further harmless ones."""
    import numpy as np

    rng = random.Random(seed)
    counts: dict[str, int] = {}
    loud: dict[str, list[int]] = {}
    for ws, y, _ in data:
        for x in ws:
            loud.setdefault(x, [0, 0])[y] += 1
    for ws, _, _ in data:
        for x in ws:
            counts[x] = counts.get(x, 0) + 1
    vocabulary = {"": PAD, "0": NUMBER, "?": UNKNOWN}
    for x, n in sorted(counts.items()):
        if n >= 8 and x not in vocabulary:
            vocabulary[x] = len(vocabulary)
    known = grammar_words()
    marked = {x for x, (n, p) in loud.items() if x in vocabulary and x in known and p >= 12 and p > 6 * n and len(x) >= 5 and x.isascii() and x.isalpha()}
    keys: dict[str, str] = {}
    for x in sorted(marked):
        for k in [x, *_slips(x)]:
            if k not in vocabulary:
                keys.setdefault(k, x)
    model = Model(vocabulary, {}, keys)
    most = max((len(x) for ws, _, _ in data for x in ws), default=1)  # of a word's trigrams, all

    def coded(windows):
        ids = np.zeros((len(windows), WINDOW), np.int64)
        tri = np.full((len(windows), WINDOW, most), -1, np.int16)
        for i, ws in enumerate(windows):
            for j, x in enumerate(ws[:WINDOW]):
                x = model.canonical(x) if rng.random() < 0.8 else x
                # Words are hidden at times, so that their letters alone learn to tell.
                ids[i, j] = vocabulary.get(x, UNKNOWN) if rng.random() > 0.15 else UNKNOWN
                if x != "0":
                    t = trigrams(x)[:most]
                    tri[i, j, : len(t)] = t
        return ids, tri

    ids, tri = coded([ws for ws, _, _ in data])
    y = np.array([v[1] for v in data], np.float32)
    wt = np.array([v[2] for v in data], np.float32)
    g = np.random.default_rng(seed)
    scale = lambda *s: (g.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    w = {"E": (g.normal(size=(len(vocabulary), DIM)) * 0.1).astype(np.float32), "C": (g.normal(size=(TRIGRAMS, DIM)) * 0.2).astype(np.float32)}
    w["E"][PAD] = 0
    for d in "fb":
        w["W" + d], w["U" + d], w["b" + d] = scale(DIM, 3 * HIDDEN), scale(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
    w |= {"A": scale(2 * HIDDEN, ATTENTION), "v": scale(ATTENTION), "o": scale(2 * HIDDEN), "q": np.zeros(1, np.float32)}
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    step, batch = 0, 256
    for epoch in range(epochs):
        rate = 0.006 * (1 - epoch / epochs) + 0.0006
        if epoch in (2, 4) and pool:  # harmless windows that look abusive so far
            model.weights = w
            fresh = Scorer(model)
            some = pool[: len(pool) // 2] if epoch == 2 else pool[len(pool) // 2 :]
            index, _ = fresh.coded([[*ws, *[""] * (WINDOW - len(ws))] for ws in some])
            scores = np.concatenate([fresh.windows(index[at : at + 8192]) for at in range(0, len(index), 8192)])
            hard = [i for i in np.argsort(-scores)[:HARD_WINDOWS].tolist() if scores[i] > 0.02]
            more = coded([some[i] for i in hard])
            ids, tri = np.concatenate([ids, more[0]]), np.concatenate([tri, more[1]])
            y, wt = np.concatenate([y, np.zeros(len(hard), np.float32)]), np.concatenate([wt, np.full(len(hard), 1.0, np.float32)])
        n = len(ids)
        order = g.permutation(n)
        for at in range(0, n, batch):
            use = order[at : at + batch]
            t = tri[use]
            t_n = np.maximum((t >= 0).sum(axis=2), 1).astype(np.float32)
            grad, dx = _step(w, ids[use], t, t_n, y[use], wt[use])
            grad["E"] = np.zeros_like(w["E"])
            np.add.at(grad["E"], ids[use].reshape(-1), dx.reshape(-1, DIM))
            grad["E"][PAD] = 0
            grad["C"] = np.zeros_like(w["C"])
            has = t >= 0
            np.add.at(grad["C"], t[has], np.broadcast_to((dx / t_n[..., None])[:, :, None, :], (*t.shape, DIM))[has])
            step += 1
            for k, v in grad.items():
                v = v + (1e-5 * w[k] if k in "EC" else 0)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    w["E"][PAD] = 0
    model.weights = w
    return model


# --- scoring ---------------------------------------------------------------------------------


class Scorer:
    """Scores texts with the input projections of every distinct word kept."""

    def __init__(self, model: Model, *others: Model):
        import numpy as np

        self.model = model
        self.others = [Scorer(m) for m in others]
        w = model.weights
        self.both = np.concatenate([w["Wf"], w["Wb"]], axis=1)
        self.bias = np.concatenate([w["bf"], w["bb"]])
        self.index: dict[str, int] = {"": PAD}
        self.table = np.zeros((1 << 12, 6 * HIDDEN), np.float32)
        self.table[0] = self.bias
        self.used = 1

    def _add(self, tokens: list[str]) -> None:
        import numpy as np

        if self.used + len(tokens) > 600_000:
            self.index = {"": PAD}
            self.used = 1
        while self.used + len(tokens) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        vec = np.stack([self.model.vector(reading(t)) for t in tokens])
        self.table[self.used : self.used + len(tokens)] = vec @ self.both + self.bias
        for i, t in enumerate(tokens):
            self.index[t] = self.used + i
        self.used += len(tokens)

    def windows(self, ids):
        """Scores of windows of word ids (n, WINDOW)."""
        import numpy as np

        w = self.model.weights
        n, h2 = len(ids), 2 * HIDDEN
        half = np.float32(0.5)
        hs = np.empty((WINDOW, n, h2), np.float32)
        for d, at in (("f", 0), ("b", HIDDEN)):
            off = 0 if d == "f" else 3 * HIDDEN
            part = np.ascontiguousarray(self.table[: self.used, off : off + 3 * HIDDEN])
            u = w["U" + d]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                x = part[ids[:, t]]
                hu = h @ u
                gates = x[:, :h2]
                gates += hu[:, :h2]
                gates *= half
                np.tanh(gates, out=gates)  # sigmoid(x) = (tanh(x / 2) + 1) / 2
                gates += 1
                gates *= half
                c = hu[:, h2:]
                c *= gates[:, :HIDDEN]
                c += x[:, h2:]
                np.tanh(c, out=c)
                h -= c
                h *= gates[:, HIDDEN:]
                h += c
                hs[t, :, at : at + HIDDEN] = h
        s = np.tanh(hs.reshape(-1, h2) @ w["A"]) @ w["v"]
        s = s.reshape(WINDOW, n) + np.where(ids.T == PAD, np.float32(-30), np.float32(0))
        s -= s.max(axis=0)
        np.exp(s, out=s)
        s /= s.sum(axis=0)
        each = (hs.reshape(-1, h2) @ w["o"]).reshape(WINDOW, n)
        return _sigmoid((s * each).sum(axis=0) + w["q"][0])

    def ids(self, texts: list[str | None]):
        """Word ids of all texts together, and the count of each text."""
        import numpy as np

        ids, n = self.coded([_TOKEN.findall(plain(t)) if t else [] for t in texts])
        return ids.reshape(-1), n

    def mean(self, tokens: list[list[str]], own):
        """Mean score of all networks of windows of tokens; ``own`` are the first one's."""
        total = own.astype("f4").copy()
        for s in self.others:
            ids, _ = s.coded([[*w, *[""] * (WINDOW - len(w))] for w in tokens])
            total += s.windows(ids)
        return total / (1 + len(self.others))

    def coded(self, tokens: list[list[str]]):
        """Ids of the tokens (one row a list where all are as long as a window), and the count of each list."""
        import numpy as np

        fresh = sorted(set().union(*tokens).difference(self.index))
        for at in range(0, len(fresh), 20_000):
            self._add(fresh[at : at + 20_000])
        get = self.index.__getitem__
        n = np.fromiter(map(len, tokens), np.int64, count=len(tokens))
        flat = np.fromiter((i for ts in tokens for i in map(get, ts)), np.int64, count=int(n.sum()))
        return (flat.reshape(-1, WINDOW) if len(n) and (n == WINDOW).all() else flat), n

    def passage(self, text: str) -> str:
        """Of a long text the stretch of words that scores highest, whole if short."""
        import numpy as np

        found = list(_TOKEN.finditer(plain(text)))
        if len(found) <= WINDOW:
            return text
        ids, _ = self.ids([text])
        win = np.stack([ids[a : a + WINDOW] for a in range(len(found) - WINDOW + 1)])
        best = int(np.argmax(self.windows(win)))
        return plain(text)[found[best].start() : found[best + WINDOW - 1].end()]

    def score(self, texts: list[str | None]):
        """The highest window score of each text; 0 without a word."""
        import numpy as np

        tokens = [_TOKEN.findall(plain(t)) if t else [] for t in texts]
        ids, n = self.coded(tokens)
        ids = ids.reshape(-1)
        out = np.zeros(len(texts), np.float32)
        # Windows start every STEP words while a window's first half holds words.
        many = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STEP)) // STEP)), 0)
        if not many.sum():
            return out
        doc = np.repeat(np.arange(len(texts)), many)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        begin, end = np.cumsum(n) - n, np.cumsum(n)
        padded = np.concatenate([ids, np.zeros(WINDOW, np.int64)])
        first = begin[doc] + k * STEP
        def each(doc, first):
            for at in range(0, len(doc), 8192):
                d = doc[at : at + 8192]
                pos = first[at : at + 8192, None] + np.arange(WINDOW)
                win = np.where(pos < end[d, None], padded[np.minimum(pos, len(padded) - 1)], PAD)
                got = self.windows(win)
                near = np.flatnonzero(got >= NEAR)
                if self.others and len(near):
                    begun = (first[at : at + 8192] - begin[d])[near].tolist()
                    got[near] = self.mean([tokens[k][a : a + WINDOW] for k, a in zip(d[near].tolist(), begun)], got[near])
                np.maximum.at(out, d, got)
                yield got

        scores = np.concatenate(list(each(doc, first)))
        # Between two steps, where a passage may stand whole that no step holds.
        unsure = np.flatnonzero((scores >= NEAR) & (out[doc] < THRESHOLD))
        shift = np.concatenate([np.arange(1 - STEP, 0), np.arange(1, STEP)])
        d = np.repeat(doc[unsure], len(shift))
        at = (first[unsure, None] + shift).reshape(-1)
        inside = (at >= begin[d]) & (at < end[d])
        key = np.unique(at[inside])
        for _ in each(np.searchsorted(end, key, side="right"), key):
            pass
        return out


_fitted: dict[tuple, list[Model]] = {}


def _fit_all(spark: SparkSession, examples: list[tuple[str, int]], public: list[str], seeds: list[int]) -> list[Model]:
    """A model for every seed, each fitted in a task; a model is about 1 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pickle.dumps(train(examples, seed=seeds[i], public=public)) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "model"])

    rows = spark.range(0, len(seeds), 1, len(seeds)).mapInArrow(run, "id bigint, model binary").collect()
    return [pickle.loads(bytes(r["model"])) for r in sorted(rows, key=lambda r: r["id"])]


def fitted(spark: SparkSession, examples: list[tuple[str, int]], folder: str = VOCABULARIES) -> list[Model]:
    """The networks of these examples, fitted once a process."""
    of = (tuple(examples), folder, NETWORKS)
    if of not in _fitted:
        _fitted.clear()
        _fitted[of] = _fit_all(spark, examples, vocabulary_words(folder), [SEED + i for i in range(NETWORKS)])
    return _fitted[of]


def score(df: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "item_id", label_text: str = "text", label: str = "abusive", folder: str = VOCABULARIES) -> DataFrame:
    """``key, score double``: the abuse score of every row; ``folder`` holds the public vocabularies."""
    rows = examples.select(F.col(label_key).alias("k"), F.col(label_text).alias("t"), F.col(label).cast("int").alias("y")).where("t IS NOT NULL AND y IS NOT NULL").orderBy("k", "t").limit(FIT_ROWS).collect()
    known = [(r["t"], r["y"]) for r in rows]
    # No row that is scored takes part in the fit.
    shared = df.sparkSession.sparkContext.broadcast(fitted(df.sparkSession, known, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.score(part.column(1).to_pylist()).astype("f8"))], names=["k", "s"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, s double")
    return out.select(F.col("k").alias(key), F.col("s").alias("score"))


def rates(df: DataFrame, scores: DataFrame, key: str = "doc_id", source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``source, documents, abusive, rate``; a null source is a group of its own."""
    both = df.select(F.col(key).alias("k"), F.col(source).alias("source")).join(scores.select(F.col(key).alias("k"), "score"), "k")
    by = both.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= threshold).cast("bigint")).alias("abusive"))
    return by.withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
