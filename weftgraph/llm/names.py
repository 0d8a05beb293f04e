"""Variant spellings of names typed by people (problem 2).

Method: pigeonhole segment join.  A name is read as a *kind* (given name, line
of business, or fund type and number) and a *core* (surname or brand).  Cores of
one kind are joined: each is cut into ``k + 1`` segments that go into an
inverted index, position-shifted substrings of the others look them up, and a
banded edit distance verifies what they meet.  ``k`` follows the core's length
(``edits``): none below ``ONE_EDIT`` letters, so that Hall, Hill and Ball stay
apart.  A met pair is linked by its own evidence (``_linked``): its distance and
length, the first letters, and whether one spelling is much rarer than the other;
two spellings that are both well attested are two names.  The links are closed
into groups.

The lines of business, fund types, given names and quoted nicknames are counted
over all names; a word enters a list by its share of the names, so the lists
stay bounded.  Known short forms come from an alias table.

Results: pairs of rows whose names differ as stored and mean the same person or
organisation, directly or through other spellings.  Null names, names without a
readable core (empty, blank, only punctuation) and rows that are events,
metrics, places, products or documents are in no pair.  A first name given only
as an initial, or as a nickname of several names, is linked when one bearer of
the surname fits and is left alone when several do.  Names of any length are
read whole.  Repeated rows share their group; equal names make no pair.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import components
from weftgraph.plans import Scratch, lookup

K = 2  # edits at most
#: Letters of the shorter core from which one and two edits link.
ONE_EDIT, TWO_EDITS = 6, 8
#: Two cores that each stand in so many spellings, neither in ``RARER`` times as many as the other, are two names.
ATTESTED, RARER = 3, 8
#: Rows of a group in a block of ``found_pairs``, about.
BLOCK_ROWS = 64
#: A word, phrase or nickname is common when at least this share of the names has it.
COMMON_SHARE = 1 / 4000
COMMON_LEAST = 3

# General knowledge about names, in plain lists.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "dame", "lord", "lady", "hon", "rev"}
SUFFIXES = {"cfo", "ceo", "coo", "cto", "cio", "phd", "cfa", "cpa", "md", "mba", "esq", "jr", "sr", "msc", "bsc", "ma", "dds", "llm", "jd", "frm", "obe", "mbe"}
LEGAL = [
    ["public", "limited", "company"], ["limited", "liability", "company"], ["limited", "partnership"], ["aktiengesellschaft"], ["incorporated"], ["corporation"],
    ["limited"], ["company"], ["gesellschaft", "mit", "beschrankter", "haftung"], ["plc"], ["p", "l", "c"], ["inc"], ["corp"], ["ltd"], ["co"], ["ag"], ["a", "g"], ["llc"], ["llp"], ["lp"], ["l", "p"], ["gmbh"], ["sa"], ["nv"], ["bv"], ["se"], ["kg"],
]
FUND_WORDS = {"fund", "fd", "fnd", "funds"}
FUND_TYPES = ["growth", "bond", "income", "venture", "infrastructure", "equity", "credit", "value"]
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]
NICKNAMES = """
william bill billy will willy liam; elizabeth liz lizzie beth betty betsy eliza libby; katherine kate kathy katie kat kit; thomas tom tommy; anthony tony ant;
patricia pat patty trish tricia; susan sue susie suzy; victoria vicky vic tori; benjamin ben benny benji; josephine jo josie; eleanor nell ellie nora; dorothy dot dolly dottie;
charles chuck charlie chas; henry hank harry hal; nicholas nick nico nicky; rebecca becky becca; deborah deb debbie; jennifer jen jenny; daniel dan danny; matthew matt matty;
philip phil pip; barnaby barney; penelope penny nell; zachary zach zack; ulrich uli; gabriel gabe; isabella bella izzy belle; augustus gus; leonard len lenny leo; margaret peggy maggie meg madge marge greta;
alexander alex sasha sandy xander al; frederick fred freddie freddy fritz; gregory greg; christopher chris kit topher; virginia ginny gina; winifred winnie freddie; samuel sam sammy;
robert bob bobby rob robbie bert; abigail abby gail; edward ed eddie ned ted teddy; james jim jimmy jamie; theodore theo ted teddy; stephen steve stevie; olivia liv livvy ollie; michael mike mick mickey;
lawrence larry laurie; richard dick rick ricky rich; john jack johnny; joseph joe joey; david dave davy; andrew andy drew; timothy tim; jonathan jon; ronald ron; donald don; kenneth ken; peter pete;
catherine cathy cate; barbara barb; mary molly polly; ann annie nan nancy; sarah sally sadie; helen nell; martha patty; francis frank; frances fanny fran
"""  # fmt: skip


def fold(text: str) -> str:
    """Compatibility form without diacritics, entities and invisible characters; case kept."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", html.unescape(text)))
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return text.translate(_FOLD)


#: Letters that no decomposition reaches, and quotation marks.
_FOLD = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "«": '"', "»": '"', "„": '"', "–": "-", "—": "-", "‐": "-", "‑": "-"})
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[a-z0-9&]+")


def words(text: str) -> list[str]:
    """Lower-case words; F&B and Int'l are one word, a lone & is "and"."""
    text = _CAMEL.sub(" ", text.replace("_", " ")).lower().replace("'", "")
    text = re.sub(r"(?<=[a-z])-(?=[a-z])", "", text)
    return ["and" if w == "&" else w.strip("&") for w in _WORDS.findall(text) if w.strip("&") or w == "&"]


def edit1(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def strip_legal(w: list[str]) -> tuple[list[str], bool]:
    """Without legal forms at the end; whether there was one."""
    found = True
    some = False
    while found:
        found = False
        for form in LEGAL:
            # "X Ag. Corporation": before another form, Ag. is a line of business.
            if len(w) > len(form) and w[-len(form) :] == form and not (some and form == ["ag"]):
                w, found, some = w[: -len(form)], True, True
                break
        else:
            # A typed-over long form ("Incorporatde", "Limted").
            if len(w) > 2 and len(w[-1]) >= 6 and any(len(f) == 1 and len(f[0]) >= 7 and edit1(w[-1], f[0]) for f in LEGAL):
                w, found, some = w[:-1], True, True
    return w, some


def number(w: str) -> int | None:
    if w.isdigit() and len(w) <= 3:
        return int(w)
    if w in ROMAN:
        return ROMAN.index(w) + 1
    if w in NUMBER_WORDS:
        return NUMBER_WORDS.index(w) + 1
    return None


def abbreviates(short: str, full: str) -> bool:
    """A shortening of a word: its first letter and further letters in order."""
    if len(short) < 2 or len(short) >= len(full) or short[0] != full[0]:
        return False
    rest = iter(full[1:])
    return all(c in rest for c in short[1:])


class Reader:
    """Reads a name into (kind, core) with the lists counted over all names."""

    def __init__(self, sectors: list[str], shorts: dict[str, str], given: list[str], nicks: dict[str, set[str]], votes: dict[str, tuple[float, float, float]]):
        self.sectors = [(s, [x for x in s.split() if x != "and"], s.split()) for s in sectors]
        self.squeezed = sorted({s.replace(" ", ""): s for s in sectors}.items(), key=lambda x: -len(x[0]))
        self.shorts = shorts  # squeezed short form -> sector
        self.given = set(given) | {g for full in nicks.values() for g in full}
        self.nicks = nicks
        self.votes = votes
        self._sector: dict[tuple[str, ...], tuple[int, str] | None] = {}
        self._given: dict[str, tuple[str, ...]] = {}

    # -- organisations --

    def sector(self, w: tuple[str, ...]) -> tuple[int, str] | None:
        """(quality, sector) of the words, 0 best; None when none or several fit."""
        if w not in self._sector:
            if len(self._sector) > 500_000:
                self._sector.clear()
            self._sector[w] = self._read_sector(w)
        return self._sector[w]

    def _read_sector(self, w: tuple[str, ...]) -> tuple[int, str] | None:
        if not w:
            return None
        joined = "".join(w)
        bare = [x for x in w if x != "and"]
        fits: list[tuple[int, str]] = []
        for s, parts, full in self.sectors:
            whole = "".join(full)
            if joined == whole or "".join(bare) == "".join(parts):
                fits.append((0, s))
            elif self.shorts.get(joined) == s:
                fits.append((1, s))
            elif len(whole) >= 6 and edit1(joined, whole):
                fits.append((1, s))
            elif len(parts) > 1 and joined.replace("&", "") in ("".join(p[0] for p in parts), "".join(p[0] for p in full)):
                fits.append((2, s))
            elif len(bare) == len(parts) and all(a == b or (len(b) >= 5 and edit1(a, b)) or (a != "" and b.startswith(a)) for a, b in zip(bare, parts)):
                fits.append((3, s))
            elif len(bare) == len(parts) and all(a == b or abbreviates(a, b) or (len(b) >= 5 and edit1(a, b)) for a, b in zip(bare, parts)):
                fits.append((4, s))
        if not fits:
            return None
        best = min(q for q, _ in fits)
        top = {s for q, s in fits if q == best}
        return (best, top.pop()) if len(top) == 1 else None

    def fund(self, w: list[str]) -> tuple[str, str] | None:
        """(kind, core) of a fund's words."""
        w = strip_legal(w)[0]
        if not any(x in FUND_WORDS for x in w):
            squeezed = "".join(w)
            m = re.fullmatch(r"(.*?)(growth|bond|income|venture|infrastructure|equity|credit|value)(fund|fd)(no)?(\d{1,3}|[ivx]{1,4}|" + "|".join(NUMBER_WORDS) + ")?(.*)", squeezed)
            if not m:
                return None
            n = number(m[5]) if m[5] else None
            core = m[1] + m[6]
            return (f"fund {m[2]} {n}", core) if core else None
        at = next(i for i, x in enumerate(w) if x in FUND_WORDS)
        n, kind, core = None, None, []
        for i, x in enumerate(w):
            if x in FUND_WORDS or x in ("no", "number", "nr", "lp", "the"):
                continue
            v = number(x)
            if v is not None and n is None and i > at:
                n = v
            elif kind is None and (hit := next((t for t in FUND_TYPES if x == t or (len(x) > 4 and edit1(x, t)) or (abbreviates(x, t) and i == at - 1)), None)):
                kind = hit
            else:
                core.append(x)
        return (f"fund {kind} {n}", "".join(core)) if core and kind else None

    def organisation(self, text: str, sure: bool) -> tuple[str, str] | None:
        plain = re.sub(r"[()\"]", " ", text)
        w = words(plain)
        if w and w[0] == "the" and len(w) > 1:
            w = w[1:]
        elif w and w[0].startswith("the") and len(w) == 1:
            w = [w[0][3:]] if w[0][3:] else w
        got = self.fund(w)
        if got:
            return got
        w = _join_initials(w)
        bare, legal = strip_legal(w)
        options: list[tuple[int, int, str, str]] = []
        for variant in [bare] if not legal else [bare, w]:
            for n in (1, 2):
                for core, rest in ((variant[:n], variant[n:]), (variant[-n:], variant[:-n])):
                    got2 = self.sector(tuple(rest)) if core and rest else None
                    if got2 and len("".join(core)) >= 4:
                        options.append((got2[0] + (5 if variant is w and legal else 0), n, got2[1], "".join(core)))
            if len(variant) <= 3:  # written together
                squeezed = "".join(variant)
                if not legal and len(variant) == 1:
                    for form in sorted(("".join(f) for f in LEGAL), key=len, reverse=True):
                        if squeezed.endswith(form) and len(form) > 2:
                            squeezed = squeezed[: -len(form)]
                            break
                for s, name in self.squeezed:
                    if squeezed.endswith(s) and len(squeezed) - len(s) >= 4:
                        options.append((3, 1, name, squeezed[: -len(s)]))
                    elif squeezed.startswith(s) and len(squeezed) - len(s) >= 4:
                        options.append((3, 2, name, squeezed[len(s) :]))
        if options:
            _, _, name, core = min(options)
            return f"org {name}", core
        if not bare or not (sure or legal):
            return None
        return "org ? " + " ".join(sorted(bare[1:])), bare[0]

    # -- people --

    def full_given(self, g: str) -> tuple[str, ...]:
        """Full given names that ``g`` may stand for."""
        if g not in self._given:
            if len(self._given) > 500_000:
                self._given.clear()
            if g in self.nicks:
                got = tuple(sorted(self.nicks[g] | ({g} if g in self.given else set())))
            elif g in self.given:
                got = (g,)
            elif len(g) >= 4:
                near = {f for f in self.given if len(f) >= 4 and edit1(g, f)} or {f for n in self.nicks if len(n) >= 4 and edit1(g, n) for f in self.nicks[n]}
                got = tuple(sorted(near))
            else:
                got = ()
            self._given[g] = got
        return self._given[g]

    def person(self, text: str) -> tuple[tuple[str, ...], str, str, bool] | None:
        """(full given names, initial, surname, truncated surname)."""
        text = text.strip().strip("\"'").strip()
        text = re.sub(r"[\"(](\w[\w. ]*)[\")]", " ", text) if re.search(r"\w\s*[\"(]", text) else text.replace('"', " ")
        text = text.replace("_", " ")
        parts = [p.strip() for p in text.split(",") if p.strip()]
        keep = [p for p in parts if re.sub(r"[^a-z]", "", p.lower()) not in SUFFIXES]
        flipped = len(keep) >= 2
        if flipped:
            tail, head = keep[0], " ".join(keep[1:])
        else:
            tail, head = "", keep[0] if keep else ""

        def cut(s: str) -> list[tuple[str, bool]]:
            s = re.sub(r"(?<=[A-Za-z])-(?=[A-Za-z])", "", s)
            s = re.sub(r"\b([A-Za-z])\.(?=[A-Za-z]\b)", r"\1. ", s)
            out = [(re.sub(r"[^a-z]", "", x.lower()), x.endswith(".")) for x in _CAMEL.sub(" ", s).split()]
            out = [x for x in out if x[0]]
            while len(out) > 1 and out[0][0] in TITLES:
                out = out[1:]
            while len(out) > 2 and out[-1][0] in SUFFIXES:
                out = out[:-1]
            return out

        first, last = cut(head), cut(tail)
        if flipped:
            surname = last
            names = [x for x in first if len(x[0]) > 1]
            initials = [x[0] for x in first if len(x[0]) == 1]
            given = names[0][0] if names else ""
            surname = [x for x in surname if len(x[0]) > 1]
        else:
            initials = [x[0] for x in first if len(x[0]) == 1]
            long = [x for x in first if len(x[0]) > 1]
            if not long:
                return None
            lead = len(first[0][0]) == 1
            if len(long) == 1 and initials:
                given, surname = "", long
            elif lead:
                given, surname = "", long
            elif len(long) == 1:
                return None
            else:
                ends = [self._known(long[0][0]), self._known(long[-1][0])]
                given, surname = (long[-1][0], long[:-1]) if ends[1] > ends[0] else (long[0][0], long[1:])
        if not surname or not (given or initials):
            return None
        core = "".join(x[0] for x in surname)
        if len(core) < 2:
            return None
        truncated = surname[-1][1] and len(surname[-1][0]) > 3
        if given:
            full = self.full_given(given)
            return full or (given,), (full[0] if len(full) == 1 else given)[0], core, truncated
        return (), initials[0], core, truncated

    def _known(self, w: str) -> int:
        return 3 if w in self.nicks or w in self.given else 1 if self.full_given(w) else 0

    # -- all --

    def kind(self, text: str, typed: str | None) -> str | None:
        """org, person or None, from the stored type or else the words' votes."""
        if typed in ("organization", "person"):
            return typed
        if typed not in (None, "unknown"):
            return None
        w = words(text)
        score = [0.0, 0.0, 0.0]
        for x in w:
            for i, v in enumerate(self.votes.get(x, (0.0, 0.0, 0.0))):
                score[i] += v
        if score == [0.0, 0.0, 0.0]:
            if strip_legal(w)[1] or any(x in FUND_WORDS for x in w):
                return "organization"
            got = self.organisation(text, False)
            if got:
                return "organization"
            return "person" if 2 <= len(w) <= 4 else None
        return ("person", "organization", None)[max(range(3), key=lambda i: score[i])]


def _join_initials(w: list[str]) -> list[str]:
    """"i t" becomes "it"."""
    out: list[str] = []
    run = ""
    for x in [*w, ""]:
        if len(x) == 1:
            run += x
            continue
        if run:
            out.append(run)
            run = ""
        if x:
            out.append(x)
    return out


# --- statistics over all names ---------------------------------------------------------------


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by class, of business phrases, given names and quoted nicknames."""
    from collections import Counter

    count: Counter = Counter()
    for batch in batches:
        for name, typed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = fold(name)
            w = words(text)
            cls = {"person": "p", "organization": "o", "unknown": None, None: None}.get(typed, "x")
            if cls:
                for x in set(w):
                    if len(x) > 1:
                        count["word", cls, x] += 1
            if cls == "o":
                bare, legal = strip_legal(w)
                if legal and len(bare) > 1 and not any(x in FUND_WORDS for x in bare):
                    count["sector", "", " ".join(bare[1:])] += 1
            elif cls == "p":
                plain = [x for x in w if len(x) > 2]
                if plain and re.fullmatch(r"[A-Za-z]+ (?:[A-Z]\. )?[A-Za-z]+", text):
                    count["given", "", plain[0]] += 1
                for full, nick in re.findall(r"([A-Za-z]{3,}) [\"(]([A-Za-z]{2,})[\")] [A-Za-z]", text):
                    count["nick", full.lower(), nick.lower()] += 1
    keys = list(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array([count[k] for k in keys], pa.int64())],
        names=["what", "of", "text", "n"],
    )


def reader_from(tally: list, aliases: list[tuple[str, str, str]]) -> Reader:
    """The reader for counted lists and alias rows (full, short, kind)."""
    import math

    sectors = {r["text"] for r in tally if r["what"] == "sector"} | {" ".join(words(fold(f))) for f, _, k in aliases if k == "sector" and f}
    counts = {r["text"]: r["n"] for r in tally if r["what"] == "sector"}
    # A phrase one edit from a far commoner one is a misspelling of it; one that shortens it is an abbreviation.
    big = sorted(sectors, key=lambda s: -counts.get(s, 0))
    clean: list[str] = []
    for s in big:
        squeezed = s.replace(" ", "")
        given_full = any(k == "sector" and " ".join(words(fold(f))) == s for f, _, k in aliases if f)
        rival = [c for c in clean if counts.get(c, 0) > 4 * counts.get(s, 0)]
        w = s.split()
        derived = any(
            edit1(squeezed, c.replace(" ", "")) or (len(w) == len(c.split()) and all(a == b or abbreviates(a, b) or b.startswith(a) or edit1(a, b) for a, b in zip(w, c.split())))
            or squeezed.replace("&", "") in ("".join(p[0] for p in c.split() if p != "and"), "".join(p[0] for p in c.split()))
            or ("&" in s and len(w) < len(c.split()) and w[0][0] == c[0])
            for c in rival
        )
        if len(squeezed) >= 4 and (given_full or not derived) and not any(x in ("fund", "fd") for x in w):
            clean.append(s)
    shorts = {"".join(words(fold(s))): " ".join(words(fold(f))) for f, s, k in aliases if k == "sector" and f and s}
    nicks: dict[str, set[str]] = {}
    fulls: set[str] = set()
    for line in NICKNAMES.replace("\n", " ").split(";"):
        full, *rest = line.split()
        fulls.add(full)
        for n in rest:
            nicks.setdefault(n, set()).add(full)
    for f, s, k in aliases:
        if k == "given_name" and f and s:
            fulls.add(fold(f).lower())
            nicks.setdefault(fold(s).lower(), set()).add(fold(f).lower())
    for r in tally:
        if r["what"] == "nick" and r["of"] in fulls and r["text"] not in fulls:
            nicks.setdefault(r["text"], set()).add(r["of"])
    total = {c: 1 + sum(r["n"] for r in tally if r["what"] == "word" and r["of"] == c) for c in "pox"}
    by: dict[str, dict[str, int]] = {}
    for r in tally:
        if r["what"] == "word":
            by.setdefault(r["text"], {})[r["of"]] = r["n"]
    votes = {}
    for w, c in by.items():
        rate = [(c.get(x, 0) + 0.2) / total[x] for x in "pox"]
        mean = sum(rate)
        votes[w] = tuple(math.log(v / mean) for v in rate)
    common = max((r["n"] for r in tally if r["what"] == "given"), default=0)
    given = sorted(fulls | {r["text"] for r in tally if r["what"] == "given" and r["n"] >= max(8, common / 5)})
    return Reader(clean, shorts, given, nicks, votes)


# --- names to units, and their segments ------------------------------------------------------


def _read(shared):
    """``id, kind, core, weak, options, cut`` of every readable name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: Reader = shared.value
        for batch in batches:
            out: list[tuple] = []
            for i, name, typed in zip(*(batch.column(c).to_pylist() for c in range(3))):
                text = fold(name)
                kind = read.kind(text, typed)
                if kind == "organization":
                    got = read.organisation(text, typed is not None)
                    if got and len(got[1]) >= 2:
                        m = re.search(r"([A-Za-z]{4,})\.", text)
                        cut = bool(m) and m[1].lower() == got[1] and len(got[1]) >= 5
                        out.append((i, got[0], got[1], False, "", cut))
                elif kind == "person":
                    p = read.person(text)
                    if p:
                        full, initial, core, cut = p
                        if len(full) == 1:
                            out.append((i, f"person {full[0]}", core, False, full[0], cut))
                        else:
                            out.append((i, "person ~" + (" ".join(full) or initial), core, True, " ".join(full) or initial, cut))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_()))], names=["id", "kind", "core", "weak", "options", "cut"]
            )

    return run


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of an even partition; the later segments are the longer ones."""
    short, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = short + (1 if i >= parts - longer else 0)
        out.append((at, n))
        at += n
    return out


def edits(length: int) -> int:
    """Edits that cores of a length (the shorter of two) may be apart."""
    return 0 if length < ONE_EDIT else 1 if length < TWO_EDITS else K


def _segment_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index and look-up keys of every unit: hash of (kind, length, segment number, text)."""
    import xxhash

    for batch in batches:
        unit, key, index = [], [], []
        for u, scope, core in zip(*(batch.column(c).to_pylist() for c in range(3))):
            h = xxhash.xxh3_64_intdigest(scope)
            n = len(core)
            if edits(n):
                for i, (at, size) in enumerate(segments(n, K + 1)):
                    unit.append(u)
                    key.append(xxhash.xxh3_64_intdigest(f"{n} {i} {core[at : at + size]}", h) - (1 << 63))
                    index.append(True)
            for length in range(max(ONE_EDIT, n - K), n + 1):
                seen = set()
                k, gap = K, n - length  # a swap where one edit is allowed is met as two
                if gap > edits(length):
                    continue
                for i, (at, size) in enumerate(segments(length, k + 1)):
                    # A segment moves by no more than the edits around it allow.
                    lo, hi = max(0, at - i, at + gap - (k - i)), min(n - size, at + i, at + gap + (k - i))
                    for p in range(lo, hi + 1):
                        x = xxhash.xxh3_64_intdigest(f"{length} {i} {core[p : p + size]}", h) - (1 << 63)
                        if x not in seen:
                            seen.add(x)
                            unit.append(u)
                            key.append(x)
                            index.append(False)
        yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(key, pa.int64()), pa.array(index, pa.bool_())], names=["u", "key", "index"])


def _swaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distance with a swap of neighbours as one edit."""
    for batch in batches:
        d = [1 if x == 2 and edit1(a, b) else x for a, b, x in zip(*(batch.column(c).to_pylist() for c in ("ca", "cb", "d")))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("ca"), batch.column("cb"), pa.array(d, pa.int32())], names=["a", "b", "ca", "cb", "d"])


def _allowed(least):
    """``edits`` as a column of the shorter length."""
    return F.when(least < ONE_EDIT, 0).when(least < TWO_EDITS, 1).otherwise(K)


def segment_join(units: DataFrame, rows: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """``a, b, d, ca, cb`` for units ``u, scope, core`` of one scope whose cores are at most ``edits`` of the shorter apart.

    A swap of neighbours is one edit.  ``rows`` is the
    number of units, or about: with many, keys that hold a large share of the
    look-ups are salted.
    """
    keys = units.select("u", "scope", "core").mapInArrow(_segment_keys, "u bigint, key bigint, index boolean")
    if scratch:
        keys = scratch.save(keys)
    met = lookup(keys.where("NOT index").select("key", F.col("u").alias("y")), keys.where("index").select("key", F.col("u").alias("x")), "key", 12 * rows).where("x <> y")
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    if scratch:
        met = scratch.save(met)
    core = units.select("u", "core")
    near = met.join(core.toDF("a", "ca"), "a").join(core.toDF("b", "cb"), "b")
    near = near.withColumn("d", F.levenshtein("ca", "cb", K)).where("d >= 0").select("a", "b", "ca", "cb", "d")
    return near.mapInArrow(_swaps, "a bigint, b bigint, ca string, cb string, d int").where(F.col("d") <= _allowed(F.least(F.length("ca"), F.length("cb"))))


def _linked(na: str, nb: str):
    """Whether a met pair is linked; ``na`` and ``nb`` are the numbers of spellings of its cores.

    A wrong first letter is believed only of a long core and one edit.  Only the
    pair itself decides.
    """
    first = F.substring("ca", 1, 1) == F.substring("cb", 1, 1)
    long = F.least(F.length("ca"), F.length("cb")) >= TWO_EDITS
    few, many = (f(F.expr(na), F.expr(nb)) for f in (F.least, F.greatest))
    return (first | ((F.col("d") <= 1) & long)) & ((few < ATTESTED) | (many >= RARER * few))


def link_names(names: DataFrame, aliases: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: links between the ids of ``id, name, typed`` (distinct names).

    Each kind of link is a written table: one plan of all of them holds a hundred
    shuffles, whose threads and statistics the driver keeps at once.
    """
    spark = names.sparkSession
    n = names.count()
    least = max(COMMON_LEAST, int(n * COMMON_SHARE))
    tally = names.select("name", "typed").mapInArrow(_tally, "what string, of string, text string, n bigint").groupBy("what", "of", "text").agg(F.sum("n").alias("n"))
    # At most a few entries per 1 / COMMON_SHARE names: bounded whatever the table's size.
    common = tally.where((F.col("n") >= least) | ((F.col("what") == "nick") & (F.col("n") >= max(2, least // 20)))).collect()
    listed = [(r[0], r[1], r[2]) for r in aliases.select("full_form", "short_form", "kind").collect()]
    shared = spark.sparkContext.broadcast(reader_from(common, listed))
    read = scratch.save(names.select("id", "name", "typed").mapInArrow(_read(shared), "id bigint, kind string, core string, weak boolean, options string, cut boolean"))
    # A unit is one kind and core; its first name stands for it.
    unit = scratch.save(read.groupBy("kind", "core").agg(F.min("id").alias("u"), F.count(F.lit(1)).alias("names"), F.max("weak").alias("weak"), F.max("options").alias("options"), F.max("cut").alias("cut")))
    own = scratch.save(read.join(unit.select("kind", "core", "u"), ["kind", "core"]).select(F.col("u").alias("a"), F.col("id").alias("b")).where("a <> b"))
    strong = unit.where("NOT weak")
    pairs = scratch.save(segment_join(strong.select("u", F.col("kind").alias("scope"), "core"), n, scratch))
    held = unit.select("u", "names")
    judged = pairs.join(held.toDF("a", "na"), "a").join(held.toDF("b", "nb"), "b")
    close = scratch.save(judged.where(_linked("na", "nb")).select("a", "b"))
    # Cores cut short by a full stop: exact prefix look-up.
    heads = strong.select("kind", "core", "u").where(F.length("core") >= 6)
    prefix = heads.select("kind", "u", F.explode(F.sequence(F.lit(5), F.length("core") - 1)).alias("l"), "core").select("kind", "u", F.expr("substring(core, 1, l)").alias("head"))
    short = strong.where("cut").select("kind", F.col("core").alias("head"), F.col("u").alias("b"))
    truncated = scratch.save(short.join(prefix, ["kind", "head"]).select(F.col("u").alias("a"), "b"))
    # Initials and ambiguous nicknames against the full names of the surname.
    weak = unit.where("weak").select("u", "core", "options")
    full = strong.where("kind LIKE 'person %'").select("u", "core", "options")
    letter = lambda df: df.select("u", "core", "options", F.explode(F.array_distinct(F.transform(F.split("options", " "), lambda x: F.substring(x, 1, 1)))).alias("scope"))
    both = scratch.save(letter(weak).withColumn("w", F.lit(True)).union(letter(full).withColumn("w", F.lit(False))))
    met = segment_join(scratch.save(both.select("u", "scope", "core").distinct()), n, scratch).where("d <= 1").where(_linked("1", "1")).select("a", "b", "d")
    same = both.select("scope", "core", "u", "options", "w")
    equal = same.where("w").select("scope", "core", F.col("u").alias("x")).join(same.select("scope", "core", F.col("u").alias("y")), ["scope", "core"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(0).alias("d"))
    met = scratch.save(met).union(scratch.save(equal.distinct()))
    about = unit.where("weak OR kind LIKE 'person %'").select("u", "weak", "options")
    facts = scratch.save(met.join(about.toDF("a", "wa", "oa"), "a").join(about.toDF("b", "wb", "ob"), "b"))
    one_way = facts.where("wa AND NOT wb").select(F.col("a").alias("w"), F.col("oa").alias("wo"), F.col("b").alias("s"), F.col("ob").alias("so"), "d")
    one_way = one_way.union(facts.where("wb AND NOT wa").select("b", "ob", "a", "oa", "d"))
    fits = one_way.where("array_contains(split(wo, ' '), so) OR (length(wo) = 1 AND startswith(so, wo))")
    chosen = scratch.save(fits.groupBy("w").agg(F.min(F.struct("d", "s")).alias("best"), F.min("so").alias("least"), F.max("so").alias("most")))
    resolved = chosen.where("least = most").select(F.col("w").alias("a"), F.col("best.s").alias("b"))
    alone = facts.where("wa AND wb AND oa = ob").join(chosen.select(F.col("w").alias("a")), "a", "left_anti").join(chosen.select(F.col("w").alias("b")), "b", "left_anti").select("a", "b")
    alone = scratch.save(alone)
    return own.union(close).union(truncated).union(resolved).union(alone)


def same_entities(df: DataFrame, aliases: DataFrame, key: str = "vec_id", name: str = "entity_name", kind: str = "entity_type") -> tuple[DataFrame, DataFrame]:
    """``(members, groups)``: ``row, name, grp`` of rows in groups of several names, and the groups."""
    scratch = Scratch(df.sparkSession, "names")
    rows = df.select(F.col(key).cast("bigint").alias("row"), F.col(name).cast("string").alias("name"), F.lower(F.trim(F.col(kind))).alias("typed")).where("row IS NOT NULL AND name IS NOT NULL")
    known = F.when(~F.col("typed").isin("unknown", ""), F.col("typed"))
    # A name that any of its rows calls a person or an organisation is read as one.
    counted = F.when(F.col("typed").isin("person", "organization"), F.col("typed"))
    names = scratch.save(rows.groupBy("name").agg(F.min("row").alias("id"), F.coalesce(F.min(counted), F.min(known)).alias("typed")).select("id", "name", "typed"))
    links = scratch.save(link_names(names, aliases, scratch))
    groups = scratch.save(components.groups(links).select("id", F.col("group_id").alias("grp")))
    grouped = names.select("id", "name").join(groups, "id")
    # A row of a type that never counts is left out though another row of its name counts.
    counts = F.coalesce(F.col("typed"), F.lit("unknown")).isin("person", "organization", "unknown", "")
    members = lookup(rows.where(counts).select("row", "name"), grouped.select("name", "grp"), "name", rows.count())
    return scratch.save(members), groups


def found_pairs(members: DataFrame) -> DataFrame:
    """``a, b``: rows of one group whose names differ as stored.

    Groups are cut in blocks of about ``BLOCK_ROWS`` rows and a job joins two
    blocks, so that a group with a third of all rows spreads over all tasks.
    """
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = sizes.select("grp", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    scratch = Scratch(members.sparkSession, "pairs")
    blocks = scratch.save(blocks)
    put = lookup(members, blocks, "grp", members.count()).select("grp", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), F.struct("row", "name").alias("r"))
    listed = scratch.save(put.groupBy("grp", "block").agg(F.collect_list("r").alias("rs")))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    jobs = blocks.select("grp", "blocks", F.explode(upto("blocks")).alias("i")).repartition("grp", "i").select("grp", "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
    sides = jobs.join(listed.toDF("grp", "i", "la"), ["grp", "i"]).join(listed.toDF("grp", "j", "lb"), ["grp", "j"])
    out = sides.select((F.col("i") == F.col("j")).alias("once"), F.explode("la").alias("x"), "lb").select("once", "x", F.explode("lb").alias("y"))
    out = out.where("x.name <> y.name AND (NOT once OR x.row < y.row)")
    return out.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b"))


def classes(members: DataFrame) -> DataFrame:
    """Short form: ``row, class_id, rows, names`` of every member, without pairs; ``class_id`` is the group's smallest row."""
    of = members.groupBy("grp").agg(F.min("row").alias("class_id"), F.count(F.lit(1)).alias("rows"), F.count_distinct("name").alias("names")).where("names > 1")
    return lookup(members.select("row", "grp"), of, "grp", members.count()).select("row", "class_id", "rows", "names")
