"""Secret scan: fixed patterns, and a linear-chain conditional random field over all tokens of a text.

A token is a run of letters and digits or one other character that is not white space. The field sees a token's
shape, the stretch without white space it stands in, its neighbours, names of credentials before it, and the file.
Tags are begin, inside (only where no white space stands before) and outside. Whole texts are decoded by Viterbi:
a token that is outside in every best path, whatever its neighbours are, cuts the text, and what is between such
tokens is decoded by itself, which gives the path of the whole text.

The field is trained here on windows of consecutive tokens from a bounded sample of documents, whose tokens inside
a match of the fixed patterns are secret, and on generated credentials of other kinds (and things that look like
them) put between words of these documents.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .quality import one_of_each_id

ASSIGN = re.compile(r"(?a:(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Tokens that name a credential, in a few languages.
NAMES = ("secret", "token", "key", "pwd", "credential", "bearer", "auth", "clave", "contrase")
PASS_NAMES = ("passw", "passphrase", "passe")
PIECE = re.compile(r"\s+|[^\W_]+|[\W_]")
KINDS = ("assign", "access", "hex", "crf")
OUT, BEGIN, INSIDE = range(3)
N_FEATURES = 1 << 14
#: Tokens in a training window, and how far before a token a name of a credential counts.
WINDOW, REACH = 16, 6
#: Tokens whose features are remembered.
REMEMBERED = 1 << 17
#: Columns of the features, by what they see: the token itself, then its neighbours, then its stretch and file.
OWN, AROUND, WIDER = 8, 4, 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(name in low for name in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    # A run of hex digits this long holds a digit or is all letters; both are matched.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def hashed(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) % N_FEATURES


#: What stands for a neighbour that is not shown.
HIDDEN = hashed("hidden")
VOWELS = str.maketrans("", "", "aeiouyäöüáéíóúàèêâîôûAEIOUY")
SHAPES = str.maketrans(dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A") | dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a") | dict.fromkeys("0123456789", "9"))


VOWEL_BYTES = b"aeiouyAEIOUY"


def names_secret(low: str) -> bool:
    """Whether a lower-case word holds a name of a credential."""
    for name in NAMES:
        if name in low:
            return True
    return "pass" in low and any(name in low for name in PASS_NAMES)


@lru_cache(1 << 12)
def look(n: int, forms: str, digits: int, upper: int, vowels: int, hexed: bool) -> list[int]:
    """Features of a token's shape: length, classes of its first characters, counts."""
    size = min(n, 8) if n < 8 else 6 + n.bit_length()
    kind = "alpha" if digits == 0 else "digit" if digits == n else "both"
    flips = sum(x != y for x, y in zip(forms, forms[1:], strict=False))
    first = "".join(c for i, c in enumerate(forms) if c != forms[i - 1:i])[:6]
    return [hashed(x) for x in (f"size{size}{kind}", f"form{first}", f"digits{6 * digits // n}{size}", f"upper{4 * upper // n}{flips > 2}", f"flips{min(flips, 12)}{size}", f"hex{hexed}{size}", f"vowels{8 * vowels // min(n, 64)}{kind}")]


def seen_of(token: str) -> list[int]:
    """Features of a token by itself, a hash of what it is to its neighbours, and its counts of digits, capitals and characters, whether it names a credential, whether it is white space."""
    n, head, low = len(token), token[:64], token.lower()
    alpha = token.isalpha()
    if alpha and low == token:
        digits = upper = 0
        forms = "a"
    else:
        shaped = token.translate(SHAPES)
        digits, upper, forms = shaped.count("9"), shaped.count("A"), shaped[:64]
    bare = len(head.encode().translate(None, VOWEL_BYTES)) if head.isascii() else len(head.translate(VOWELS))
    own = look(n, forms, digits, upper, len(head) - bare, not token.strip("0123456789abcdefABCDEF"))
    word = low[:14] if alpha else token if n == 1 else "9" if digits == n else "mixed"
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return [*own, h % N_FEATURES, h >> 1, digits, upper, n, int(alpha and 2 < n < 32 and names_secret(low)), int(token.isspace())]


class Numbers(dict):
    """Numbers keys in the order they are first asked for; fresh are those not yet described."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        self[key] = n = len(self)
        return n


class Reader:
    """Turns texts into token features; remembers what tokens look like."""

    def __init__(self):
        self.number = Numbers()
        self.rows = np.zeros((1024, OWN + 6), dtype=np.int32)

    def look_up(self, pieces: list[str]) -> np.ndarray:
        if len(self.number) > REMEMBERED:
            self.number.clear()
        number, old = self.number, len(self.number)
        at = np.fromiter(map(number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        if len(number) > old:
            while len(self.rows) < len(number):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[old:len(number)] = [seen_of(p) for p in number.fresh]
            number.fresh.clear()
        return self.rows[at]

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features (token x column), whether white space or the text's start is before a token, and start and end of each token."""
        rows = self.look_up(PIECE.findall(text))
        ends = rows[:, OWN + 3].cumsum(dtype=np.int64)
        stay = np.flatnonzero(rows[:, -1] == 0)
        gap = np.diff(stay, prepend=-2) > 1
        rows, ends = rows[stay], ends[stay]
        n = len(rows)
        word, digits, upper, size, name = rows[:, OWN:-1].T
        around = np.full((n, AROUND), HIDDEN, dtype=np.int32)
        for c, step in enumerate((1, 2, 3)):
            around[step:, c] = (word[:n - step] >> 3 + c) % N_FEATURES if n > step else HIDDEN
        around[:-1, 3] = (word[1:] >> 6) % N_FEATURES
        if n:
            stretch = gap.cumsum() - gap[0]
            of = [np.bincount(stretch, weights=x)[stretch] for x in (size, digits, upper)]
            room = np.minimum(np.ceil(2 * np.log2(of[0])), 16).astype(np.int64)
            share = np.minimum(6 * of[1] // of[0], 5).astype(np.int64) + 6 * np.minimum(4 * of[2] // of[0], 3).astype(np.int64)
            told = np.concatenate([[0], name.cumsum()])
            at = np.arange(n)
            near = told[at] > told[np.maximum(at - REACH, 0)]
            lines = text.count("\n") + 1
            wider = np.stack([31 + room, 64 + share + 24 * room, 512 + near + 2 * room, np.full(n, 600 + min(len(text).bit_length(), 24)), np.full(n, 640 + min((len(text) // lines).bit_length(), 24))], axis=1)
            # Joint with glue: a token that goes on a stretch is another thing than one that opens it.
            wider[:, 0] += 700 * ~gap
        else:
            wider = np.zeros((0, WIDER), dtype=np.int32)
        return np.concatenate([rows[:, :OWN], around, (wider * 7919 % N_FEATURES).astype(np.int32)], axis=1), gap, ends - size, ends


def tags_of(spans: list[tuple[int, int]], gap: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tags of tokens from (start, end) of secrets; what goes on after white space begins anew."""
    tags = np.zeros(len(start), dtype=np.int64)
    for a, z in spans:
        i, j = np.searchsorted(end, a, "right"), np.searchsorted(start, z, "left")
        tags[i:j] = np.where(gap[i:j], BEGIN, INSIDE)
        tags[i:i + 1] = BEGIN
    return tags


def secret_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of what the fixed patterns hold to be secret, without the name before it, joined where they overlap."""
    found = sorted([(m.start(1), m.end(1)) for m in ASSIGN.finditer(text) if len(m[1]) >= 8] + [(a, z) for a, k, z in base_spans(text) if k])
    out: list[tuple[int, int]] = []
    for a, z in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def windows(text: str, spans: list[tuple[int, int]], reader: Reader) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, gap, tags) of consecutive windows; none opens or ends inside a secret."""
    x, gap, start, end = reader.read(text)
    tags = tags_of(spans, gap, start, end)
    out, a = [], 0
    while a < len(tags):
        z = min(a + WINDOW, len(tags))
        while z < len(tags) and tags[z] == INSIDE:
            z += 1
        out.append((x[a:z], gap[a:z], tags[a:z]))
        a = z
    return out


def tagged(text: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of a text as training sequences."""
    return both_ways(windows(text, secret_values(text), Reader()))


def both_ways(data: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each window, and once more without its neighbours: shape alone must do, too."""
    out = []
    for x, gap, tags in data:
        bare = x.copy()
        bare[:, OWN:OWN + AROUND] = HIDDEN
        out += [(x, gap, tags), (bare, gap, tags)]
    return out


LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALNUM = LETTERS + LETTERS.upper() + "0123456789"


def made(kind: str, rng: np.random.Generator) -> tuple[str, str, str]:
    """(text before, the thing, text after) of a generated credential, or of a benign look-alike, in the given kind."""

    def some(chars: str, low: int, high: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), rng.integers(low, high + 1)))

    def one(*of: str) -> str:
        return of[rng.integers(len(of))]

    name = one("key", "access key", "token", "secret", "credentials", "auth", "client secret", "bearer", "signing key")
    said = one(" ", ": ", " = ", " is ", "=", ' "')
    year, month, day = rng.integers(1990, 2040), rng.integers(1, 13), rng.integers(1, 29)
    if kind == "prefixed":
        sep = one("_", "-")
        return one("", f"{name}{said}"), some(LETTERS, 2, 5) + sep + one("", some(LETTERS, 3, 6) + sep) + some(ALNUM, 16, 44), ""
    if kind == "bare":
        return f"{name}{said}", some(ALNUM + one("", "+/"), 20, 64), ""
    if kind == "capitals":
        return one("", f"{name}{said}"), some("0123456789ABCDEF", 20, 48), ""
    if kind == "spoken":
        return one("the password", "password", "passphrase", "das Passwort", "la contraseña", "le mot de passe", "pwd", "login pass") + one(" is ", " ist ", " es ", " est ", " ", ": "), one("", some(LETTERS, 1, 4).title()) + some(ALNUM + one("", "!#$%_"), 7, 18), ""
    if kind == "address":
        return f"{one('postgres', 'mysql', 'amqp', 'https', 'redis', 'ftp')}://{some(LETTERS, 3, 8)}:", some(ALNUM + "_!", 8, 24), f"@{some(LETTERS, 3, 8)}.{one('com', 'org', 'local')}/{some(LETTERS, 2, 6)}"
    if kind == "groups":
        return one("", f"{name}{said}"), "-".join(some(ALNUM if i else LETTERS, *((10, 26) if i else (2, 4))) for i in range(rng.integers(2, 5))), ""
    if kind == "dotted":
        return one("", f"{name}{said}"), ".".join(some(ALNUM + "_-", 18, 44) for _ in range(3)), ""
    benign = (
        lambda: f"{year}-{month:02}-{day:02}T{month:02}:{day:02}:00Z", lambda: f"{some(LETTERS.upper(), 2, 4)}-{year}-{rng.integers(10**4):04}", lambda: f"IMG_{year}{month:02}{day:02}_{some('0123456789', 6, 6)}",
        lambda: "-".join(some("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)), lambda: f"978-3-{some('0123456789', 2, 3)}-{some('0123456789', 5, 6)}-{rng.integers(10)}",
        lambda: f"https://www.{some(LETTERS, 4, 9)}.com/{year}/{month:02}/{some(LETTERS, 3, 8)}-{some(LETTERS, 3, 8)}", lambda: f"v{rng.integers(9)}.{rng.integers(30)}.{rng.integers(9)}-rc{rng.integers(9)}",
        lambda: f"{some(LETTERS, 3, 8)}.{some(LETTERS, 3, 8)}{rng.integers(99)}@{some(LETTERS, 4, 9)}.org", lambda: f"+{some('0123456789', 2, 2)} {some('0123456789', 3, 4)} {some('0123456789', 6, 8)}", lambda: some("0123456789", 4, 16),
        lambda: some(LETTERS, 3, 7) + some(LETTERS, 3, 7).title() + some(LETTERS, 3, 7).title() + "()", lambda: f"{some(LETTERS, 3, 9)}{rng.integers(100)}", lambda: f"{some(LETTERS, 3, 9)}_{some(LETTERS, 3, 9)}.{one('py', 'txt', 'tar.gz', 'json')}",
        lambda: some("0123456789abcdef", 7, 10), lambda: some(LETTERS, 5, 14).upper(),
    )[rng.integers(15)]
    return one("", "", "", "the " + name + " is ", "passwords are ", "token number "), benign() if rng.random() < 0.7 else some(LETTERS, 3, 12), ""


#: Kinds of generated credentials that no fixed pattern names.
MADE = ("prefixed", "bare", "capitals", "spoken", "address", "groups", "dotted")


def planted(text: str, kind: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """Some words of a text around a generated thing, and where it is if it is a credential."""
    words = text[:20000].split(" ")
    at = int(rng.integers(0, len(words)))
    left, right = " ".join(words[max(0, at - 8):at])[-120:], " ".join(words[at:at + 8])[:120]
    before, thing, after = made(kind, rng)
    head = f"{left} {before}"
    whole = f"{head}{thing}{after}{'.' if rng.random() < 0.1 else ''} {right}"
    here = [(len(head), len(head) + len(thing))] if kind in MADE else []
    old = [(a, z) for a, z in secret_values(whole) if not any(a < q and p < z for p, q in here)]
    return whole, sorted(old + here)


class Field:
    """Weights of a linear-chain conditional random field over three tags."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 3)) if emit is None else emit
        self.move = np.zeros((3, 3)) if move is None else move
        self.move[OUT, INSIDE] = -1e9  # an inside tag needs a begin before it

    def scores(self, run, gap: np.ndarray | None = None) -> np.ndarray:
        run = np.asarray(run, dtype=np.int64)
        s = np.zeros((len(run), 3))
        for feature in run.T if len(run) else ():
            s += self.emit.take(feature, axis=0)
        if gap is not None:
            s[gap, INSIDE] = -1e9
        return s

    def best(self, s: np.ndarray) -> list[int]:
        """Viterbi, from outside and back to outside."""
        back, best = [], s[0] + self.move[OUT]
        for x in s[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + x
        tags = [int((best + self.move[:, OUT]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def decode(self, run, gap: np.ndarray | None = None) -> list[int]:
        return self.best(self.scores(run, gap))

    def whole(self, run: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The best path of a whole text, as decode gives it, by decoding only what may be a secret.

        Making a token outside costs at most the spread of the three transitions that change, and the difference
        between inside and begin of the next token, which may have to begin anew. A token that gains more than
        that is outside in every best path.
        """
        s = self.scores(run, gap)
        allowed = np.delete(self.move.ravel(), OUT * 3 + INSIDE)
        cost = 3 * (allowed.max() - allowed.min()) + 1e-6
        anew = np.append(np.maximum(s[1:, INSIDE] - s[1:, BEGIN], 0), 0)[:len(s)]
        open_ = np.flatnonzero(s[:, OUT] - s[:, 1:].max(axis=1) <= cost + anew)
        tags = np.zeros(len(s), dtype=np.int64)
        begin = np.flatnonzero(np.diff(open_, prepend=-2) > 1)
        self.paths(s, open_[begin], np.diff(begin, append=len(open_)), tags)
        return tags

    def paths(self, s: np.ndarray, first: np.ndarray, size: np.ndarray, tags: np.ndarray) -> None:
        """Writes what best gives for each stretch of s, from its first token and its size; all stretches go on step by step together."""
        if not len(first):
            return
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        going = [int(np.searchsorted(-size, -i, "left")) for i in range(int(size[0]))]  # stretches with a token i
        back, best = [], s[first] + self.move[OUT]
        for i in range(1, len(going)):
            step = best[:going[i], :, None] + self.move
            back.append(step.argmax(axis=1))
            best[:going[i]] = step.max(axis=1) + s[first[:going[i]] + i]
        now = (best + self.move[:, OUT]).argmax(axis=1)
        tags[first + size - 1] = now
        for i in range(len(going) - 1, 0, -1):
            k = going[i]
            now[:k] = back[i - 1][np.arange(k), now[:k]]
            tags[first[:k] + i - 1] = now[:k]

    def fit(self, data: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.05, decay: float = 1e-3, batch: int = 512) -> Field:
        """Adaptive gradient steps of the log-likelihood by forward-backward, windows of like length together, in an order given by a seed."""
        data = sorted(data, key=lambda d: len(d[2]))
        parts, rng = [data[a:a + batch] for a in range(0, len(data), batch)], np.random.default_rng(7)
        first, second, steps = np.zeros_like(self.emit), np.zeros_like(self.emit), 0
        first_m, second_m = np.zeros((3, 3)), np.zeros((3, 3))
        may = np.ones((3, 3))
        may[OUT, INSIDE] = 0
        for _ in range(epochs):
            for k in rng.permutation(len(parts)):
                part = parts[k]
                w, n = len(part), max(len(d[2]) for d in part)
                x, tags = np.zeros((w, n, part[0][0].shape[1]), dtype=np.int64), np.zeros((w, n), dtype=np.int64)
                there, glued = np.zeros((w, n), dtype=bool), np.ones((w, n), dtype=bool)
                for i, (f, gap, t) in enumerate(part):
                    x[i, :len(t)], tags[i, :len(t)], there[i, :len(t)], glued[i, :len(t)] = f, t, True, ~gap
                s = self.emit[x].sum(axis=2)
                s[~glued, INSIDE] = -1e9
                s[~there, BEGIN:] = -1e9  # past a window's end all is outside
                fwd, bwd = np.empty((w, n, 3)), np.empty((w, n, 3))
                fwd[:, 0] = s[:, 0] + self.move[OUT]
                for i in range(1, n):
                    fwd[:, i] = np.logaddexp.reduce(fwd[:, i - 1, :, None] + self.move, axis=1) + s[:, i]
                bwd[:, -1] = self.move[:, OUT]
                for i in range(n - 2, -1, -1):
                    bwd[:, i] = np.logaddexp.reduce(self.move + (s[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
                z = np.logaddexp.reduce(fwd[:, -1] + bwd[:, -1], axis=1)
                p = np.exp(fwd + bwd - z[:, None, None])
                g = (np.eye(3)[tags] - p) * there[:, :, None]
                flat = x.ravel()
                up = np.stack([np.bincount(flat, weights=np.repeat(g[:, :, c].ravel(), x.shape[2]), minlength=N_FEATURES) for c in range(3)], axis=1) / w - decay / 10 * self.emit
                e = np.exp(np.minimum(fwd[:, :-1, :, None] + self.move + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None], 0))
                pairs = np.bincount((tags[:, :-1] * 3 + tags[:, 1:])[there[:, 1:]], minlength=9).reshape(3, 3)
                up_m = ((pairs - (e * there[:, 1:, None, None]).sum(axis=(0, 1))) / w - decay * np.maximum(self.move, -50)) * may
                steps += 1
                for value, a, b, u in ((self.emit, first, second, up), (self.move, first_m, second_m, up_m)):
                    a += 0.1 * (u - a)
                    b += 0.01 * (u * u - b)
                    value += rate * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.99**steps)) + 1e-6)
                self.move[OUT, INSIDE] = -1e9
        return self


def lessons(text: str, seed: int, most: int, kinds: tuple[str, ...] = MADE, reader: Reader | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Training windows of one document: at most `most` of its own, those with secrets first, then by a seeded draw; and generated ones."""
    rng, reader = np.random.default_rng(seed), reader or Reader()
    own = windows(text, secret_values(text), reader)
    draw = rng.permutation(len(own))
    out = [own[i] for i in sorted(range(len(own)), key=lambda i: (not own[i][2].any(), draw[i]))[:most]]
    for kind in (kinds[rng.integers(len(kinds))], "benign", "benign") if kinds else ():
        whole, spans = planted(text, kind, rng)
        out += windows(whole, spans, reader)
    return out


def train(docs: DataFrame, max_docs: int = 3000, max_windows: int = 6, kinds: tuple[str, ...] = MADE) -> Field:
    """Fits the field on at most max_docs documents, chosen by a hash of the id, and max_windows windows of each; of rows that share an id, on one."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(ids), "doc_id").where(F.length("text") > 0)
    rows = one_of_each_id(rows, "text")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            ids, found = [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for n, (f, gap, tags) in enumerate(lessons(t, zlib.crc32(str(i).encode()), max_windows, kinds, reader)):
                    ids.append(i)
                    found.append({"n": n, "f": f.ravel().tolist(), "gap": gap.tolist(), "tags": tags.tolist()})
            run = pa.struct([("n", pa.int32()), ("f", pa.list_(pa.int16())), ("gap", pa.list_(pa.bool_())), ("tags", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, run)], names=["doc_id", "run"])

    got = rows.mapInArrow(runs, "doc_id bigint, run struct<n:int, f:array<smallint>, gap:array<boolean>, tags:array<int>>").select("doc_id", "run.*").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("n", "ascending")])
    return Field().fit(both_ways([(np.array(f.values).reshape(len(t), -1), np.array(g.values.to_pylist(), dtype=bool), np.array(t.values)) for f, g, t in zip(got["f"], got["gap"], got["tags"], strict=True)]))


def added(text: str, base: list[tuple[int, int, int]], model: Field, reader: Reader) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the field tags in a text and no span of the fixed patterns touches."""
    x, gap, start, end = reader.read(text)
    if not len(x):
        return []
    tags = model.whole(x, gap)
    first = np.flatnonzero(tags == BEGIN)
    last = np.flatnonzero((tags != OUT) & (np.append(tags[1:], OUT) != INSIDE))
    starts, reach = [s[0] for s in base], np.maximum.accumulate([0, *(s[2] for s in base)])
    return [(a, 3, z) for a, z in zip(start[first].tolist(), end[last].tolist(), strict=True) if reach[bisect_left(starts, z)] <= a]


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row for each row of docs: doc_id and spans array<struct<kind, start, end>>, ends exclusive, in code points.

    Spans of the fixed patterns always stay; the field adds spans that overlap none of them.
    Null and empty texts have no spans; repeated rows get the same answer; a null doc_id is allowed; texts of any
    length are decoded whole; of tags that score alike the earlier of outside, begin, inside is taken.
    """
    field = field or train(docs)
    emit, move = field.emit, field.move

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = Field(emit, move.copy()), Reader()
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                base = base_spans(t) if t else []
                spans = sorted(base + added(t, base, model, reader)) if t else base
                out.append([{"kind": KINDS[k], "start": a, "end": z} for a, k, z in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(load(spark, sf_dir, "documents"))

    def joined(keep):
        return F.array_join(F.transform(keep, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_digest(text: str | None) -> str:
    """What base_sha256 is for a text; for tests."""
    spans = base_spans(text or "")
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans).encode()).hexdigest()
