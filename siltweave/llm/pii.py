"""Personal data and secrets, found by a semi-Markov conditional random field.

A labelling cuts a text into segments: entities of a type, of up to ``MAX_TOKENS`` tokens and ``MAX_CHARS``
characters, and single tokens outside. A segment's score comes from features of the
whole span (formats, checksums, shape, what it touches, the word before), and neighbouring
segments add a transition weight. The best labelling, boundaries and types together, is
found by dynamic programming over all bounded segments: a format is a feature like any other, and no segment is
left out for having none. The weights are the maximum of
the conditional likelihood of generated sentences, whose entities are known; training takes seconds
and is the same on each run.

Entities are looked for in regions: runs of words, parted by any white space, that begin at a word with a digit or an at sign,
at the beginning of a key in letters, at the name of a secret and a sign, or at a title or label of a person, and
go on with such words, words that begin with a capital letter, and small words of addresses. Outside the regions
there are single tokens only, and these score nothing, so decoding region by region gives the best labelling of the whole text.
Names of persons and streets are found where a title, a label or a kind of street says so, dates where they are dates of birth.

Defined results: a null text stays null, an empty one empty, both with no spans; a text
without entities is returned unchanged; spans are in characters, half-open, in order and
disjoint; rows, repeated or not, are independent; extra columns, of any names, pass through, columns
named spans or n_spans are replaced, and the text's column can't have these names (ValueError).
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from siltweave.llm.text import place, utf8, with_arrow

TYPES = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "SECRET", "PERSON", "ADDRESS", "BIRTH")
MAX_TOKENS, MAX_CHARS = 24, 256
_NAMES = r"(?:password|passwd|pwd|secret|token|api_?key)"
_SURE = r"(?:AKIA|ASIA)[A-Z]{16}|(?:ghp_|sk-|xox[bp]-)[A-Za-z-]{16}|[a-f]{16}|[a-fA-F]{8}-[a-fA-F]{4}-|eyJ[A-Za-z]"  # keys in letters
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Señor|Señora|Mme|Monsieur|Madame)\.?(?=\s+[A-ZÀ-ÖØ-Þ])"
_LABEL = r"(?i:name|contact|patient|customer)[:=](?=\s*[A-ZÀ-ÖØ-Þ])"
_HOLDS = rf"(?:[^\s0-9@]*+[0-9@]|(?=\S*?(?:{_SURE}))\S|(?=\S*?(?i:{_NAMES})[\"']?\s*[=:])(?i:\S*?{_NAMES})[\"']?\s*[=:]\s*\S)\S*+"
_STARTS = rf"(?:{_HOLDS}|{_TITLE}\S*+|{_LABEL}\S*+)"
_SMALL = r"(?:rue|avenue|boulevard|place|chemin|de|la|du|des|von|van|der)(?!\S)"
REGION = re.compile(rf"(?<!\S){_STARTS}(?:\s++(?:{_STARTS}|[^\w\s]*+[A-ZÀ-ÖØ-Þ]\S*+|{_SMALL}))*+")
_AFTER_NAME = re.compile(rf"(?i:{_NAMES})[\"']?\s*(?:(=)\s*[\"']?|:\s*([\"'])|(:)\s*)$")
_AFTER_LABEL = re.compile(r"(?i:name|contact|patient|customer)[:=]\s*$")
_WORTH = rf"(?i:{_NAMES})[\"']?\s*[=:]|{_SURE}|(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Señor|Señora|Mme|Monsieur|Madame)\.?\s+[A-ZÀ-ÖØ-Þ]|(?i:name|contact|patient|customer)[:=]"  # in rows without digits and at signs
_BLANK = re.compile(r"\s+")
TOKEN = re.compile(r"\w+|\s|[^\w\s]")
WORD = re.compile(r"[^\W\d_]+")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), 64]] = True
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
_FORMATS = {
    "email": re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"),
    "mailbox": re.compile(r"[\w.+%-]+@[A-Za-z][\w-]*"),
    "us": re.compile(r"(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}"),
    "abroad": re.compile(r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}"),
    "ten": re.compile(r"[0-9]{10}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"),
    "ip6": re.compile(r"(?=(?:[^:]*:){3})(?:[0-9a-fA-F]{1,4}:){1,7}(?::?[0-9a-fA-F]{1,4})(?::[0-9a-fA-F]{1,4}){0,6}"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "nine": re.compile(r"[0-9]{3} [0-9]{2} [0-9]{4}|[0-9]{9}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "access": re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?:ghp_|sk-|xox[bp]-)[A-Za-z0-9-]{16,}|eyJ[\w-]+\.[\w-]+\.[\w-]+"),
    "uuid": re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
    "mixed": re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/-]{16,}=*"),
    "short": re.compile(r"(?=.*[0-9])[^\s\"',;=:]{5,15}"),
    "letters": re.compile(r"[A-Za-z_+/-]{6,15}=*"),
    "long": re.compile(r"[A-Za-z_+/-]{16,}=*"),
    "titled": re.compile(rf"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Señor|Señora|Mme|Monsieur|Madame)\.? {_CAP}(?: {_CAP}){{0,2}}"),
    "names": re.compile(rf"{_CAP}(?: {_CAP}){{1,2}}"),
    "street": re.compile(rf"[0-9]{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Way|Square)\.?"),
    "rue": re.compile(rf"[0-9]{{1,4}},? (?:rue|avenue|boulevard|place|chemin)(?: (?:de|la|du|des))*(?: {_CAP}){{1,3}}"),
    "date": re.compile(rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.](?:19|20)[0-9]{{2}}|[0-9]{{1,2}} {_CAP} (?:19|20)[0-9]{{2}}|{_CAP} [0-9]{{1,2}}, (?:19|20)[0-9]{{2}}"),
}
# prefixes and lengths that issuers of cards have
_ISSUED = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}|35[0-9]{14}|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12}|62[0-9]{14,17}")
_WEAK = {"letters", "long", "short", "names"}  # said of ordinary words as well, so they count only after the name of a secret or a label
_KEYS = {"email", "mail", "phone", "tel", "call", "card", "ssn", "iban", "token", "password", "passwd", "pwd", "secret", "key", "apikey", "ip", "host", "commit", "isbn", "version", "order", "sha"}
_KEYS |= {"born", "dob", "birth", "birthday", "geboren", "nacido", "nacida", "née", "né"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(s: str) -> bool:
    s = "".join(s.split())
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def formats(s: str) -> list[str]:
    return [k for k, p in _FORMATS.items() if p.fullmatch(s)]


def span_features(text: str, lo: int, hi: int) -> list[str]:
    """Features of text[lo:hi] as a whole, with what it touches and the word before it."""
    s = _BLANK.sub(" ", text[lo:hi])
    fits = formats(s)
    if "card" in fits:
        digits = re.sub(r"[ -]", "", s)
        fits[fits.index("card")] = "card-" if not luhn(digits) else "card+" if _ISSUED.fullmatch(digits) else "card~"
    if "iban" in fits:
        fits[fits.index("iban")] = "iban+" if s.isascii() and mod97(s) else "iban-"
    if "abroad" in fits and not 8 <= sum(c.isdigit() for c in s) <= 15:
        fits.remove("abroad")
    before, after = text[lo - 1 : lo], text[hi : hi + 1]
    left = bool(before) and (before.isalnum() or before in "._-@+%/")
    right = bool(after) and (after.isalnum() or after in "-@/_+" or after in ".:" and text[hi + 1 : hi + 2].isalnum())
    goes_on = after.isspace() and after not in "\r\n" and text[hi + 1 : hi + 2].isdigit()
    back = text[max(0, lo - 24) : lo]
    near = WORD.findall(back)
    key = near[-1].lower() if near else ""
    if key in ("on", "am", "le", "el") and len(near) > 1:
        key = near[-2].lower()
    named = _AFTER_NAME.search(back)
    sign = "=" if named and (named[1] or named[2]) else ":" if named else ""
    label = bool(_AFTER_LABEL.search(back))
    out = ["bias"]
    for k in fits:
        if k in _WEAK and not (label if k == "names" else sign):
            continue
        out += [k, f"{k}<{left}", f"{k}>{right}", f"{k}>>{goes_on}"]
        if key in _KEYS:
            out.append(f"{k}@{key}")
        if sign:
            out.append(f"{k}{sign}")
        if k == "letters" and sign:
            out.append(f"call{after in ('(', '[', '.')}{sign}")
        if k == "names":
            out.append(f"names+{bool(re.match(' [A-ZÀ-ÖØ-Þ]', text[hi : hi + 2]))}")
        if k == "titled":
            out.append(f"titled+{bool(re.match(' [A-ZÀ-ÖØ-Þ]', text[hi : hi + 2]))}")
    if len(out) == 1:
        out.append("none")
    parts = s.count(" ")
    out += [f"left{left}", f"right{right}", f"digits{min(sum(c.isdigit() for c in s), 20) // 3}", f"first{_kind(s[:1])}", f"last{_kind(s[-1:])}", f"words{min(parts, 5)}"]
    return out


def _kind(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.isalpha() else c if c in "+(@" else "p"


def candidates(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Tokens of a region, and its segments (first token, one past the last): all bounded ones that neither begin nor end in white space."""
    tokens = [(lo + m.start(), lo + m.end()) for m in TOKEN.finditer(text[lo:hi])]
    solid = [not text[a:b].isspace() for a, b in tokens]
    out = []
    for i in range(len(tokens)):
        if not solid[i]:
            continue
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            if tokens[j - 1][1] - tokens[i][0] > MAX_CHARS:
                break
            if solid[j - 1]:
                out.append((i, j))
    return tokens, out


class SemiCRF:
    """Weights by feature and type, and of transitions; label 0 is outside, type k is label k + 1, and outside after outside counts nothing."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        self.cache: dict[tuple[str, ...], np.ndarray] = {}

    def span_scores(self, text: str, lo: int, hi: int) -> np.ndarray:
        names = tuple(span_features(text, lo, hi))
        known = self.cache.get(names)
        if known is None:
            if len(self.cache) > 10_000:
                self.cache.clear()
            ids = [self.index[f] for f in names if f in self.index]
            known = self.cache[names] = self.weights[ids].sum(axis=0)
        return known

    def hopeless(self) -> np.ndarray:
        """By type, the score below which a segment is worse than its tokens outside, whatever stands around it."""
        m = self.moves
        gain = (m[:, 1:] - m[:, :1]).max(axis=0) + (m[1:, :] - m[:1, :]).max(axis=1)
        return -gain

    def decode_region(self, text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
        """Viterbi over the segments of text[lo:hi]. Segments that can't be in a best labelling, by a bound on transitions, are passed over."""
        tokens, spans = candidates(text, lo, hi)
        ending: dict[int, list[tuple[int, np.ndarray]]] = {}
        least = self.hopeless()
        for i, j in spans:
            s = self.span_scores(text, tokens[i][0], tokens[j - 1][1])
            if (s >= least).any():
                ending.setdefault(j, []).append((i, s))
        if not ending:
            return []
        n, k = len(tokens), len(TYPES) + 1
        best, back = np.full((n + 1, k), -np.inf), {}
        best[0, 0] = 0
        for j in range(1, n + 1):
            at = best[j - 1] + self.moves[:, 0]
            y = int(at.argmax())
            best[j, 0] = at[y]
            back[j, 0] = (j - 1, y)
            for i, s in ending.get(j, ()):
                at = best[i][:, None] + self.moves[:, 1:]
                y = at.argmax(axis=0)
                total = at[y, np.arange(k - 1)] + s
                for t in np.flatnonzero(total > best[j, 1:]).tolist():
                    best[j, t + 1] = total[t]
                    back[j, t + 1] = (i, int(y[t]))
        out, j, y = [], n, int((best[n] + self.moves[:, 0]).argmax())
        while j:
            i, z = back[j, y]
            if y:
                out.append((tokens[i][0], tokens[j - 1][1], TYPES[y - 1]))
            j, y = i, z
        return out[::-1]

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        return [x for m in REGION.finditer(text) for x in self.decode_region(text, m.start(), m.end())]


class Regions:
    """Regions to train on, as arrays: segments by their region, first and last place, and their features, equal ones once."""

    def __init__(self, sentences: list, index: dict[str, int]):
        kinds: dict[tuple[str, ...], int] = {}
        offset, spans, self.gold, sizes, gold = 0, [], [], [], []
        for text, marked in sentences:
            for m in REGION.finditer(text):
                tokens, cand = candidates(text, m.start(), m.end())
                first, last = {a: x for x, (a, _) in enumerate(tokens)}, {b: x + 1 for x, (_, b) in enumerate(tokens)}
                inside = {(first[a], last[b]): TYPES.index(t) for a, b, t in marked if m.start() <= a and b <= m.end()}
                for i, j in cand:
                    names = tuple(span_features(text, tokens[i][0], tokens[j - 1][1]))
                    u = kinds.setdefault(names, len(kinds))
                    if (i, j) in inside:
                        gold.append((len(spans), inside[i, j]))
                    spans.append((offset + i, offset + j, u))
                sizes.append(len(tokens))
                offset += len(tokens) + 1
        self.start, self.end, self.kind = (np.array(x, np.int64) for x in zip(*spans))
        self.sizes = np.array(sizes)
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]
        self.gold = gold
        feats = [[index.setdefault(f, len(index)) for f in names] for names in kinds]
        self.feat = np.concatenate([np.array(f) for f in feats])
        self.owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        self.kinds, self.places = len(feats), offset


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - m).sum(axis=axis)) + np.squeeze(m, axis)


def _grouped(x: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the sums of exp(x) of the rows that go to one place, and the places; rows come in order of places."""
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    m = np.maximum.reduceat(x, cut)
    m = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.add.reduceat(np.exp(x - np.repeat(m, np.diff(np.append(cut, len(x))), axis=0)), cut)) + m, to[cut]


def likelihood(r: Regions, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the regions' gold labels and its gradients; all regions go forward and backward together."""
    k = moves.shape[0]
    by_kind = np.zeros((r.kinds, k - 1))
    np.add.at(by_kind, r.owner, weights[r.feat])
    s = by_kind[r.kind]
    a, b = np.full((r.places, k), -np.inf), np.full((r.places, k), -np.inf)
    a[r.first, 0] = 0.0
    last = r.first + r.sizes
    b[last] = moves[:, 0]
    home = np.searchsorted(r.first, r.start, "right") - 1
    by_end, by_start = np.argsort(r.end, kind="stable"), np.argsort(r.start, kind="stable")
    local_end, local_start = (r.end - r.first[home])[by_end], (r.start - r.first[home])[by_start]
    ends = [by_end[local_end == j] for j in range(r.sizes.max() + 1)]
    starts = [by_start[local_start == j] for j in range(r.sizes.max() + 1)]
    for j in range(1, r.sizes.max() + 1):
        at = r.first[r.sizes >= j] + j
        a[at, 0] = _lse(a[at - 1] + moves[:, 0], 1)
        if len(x := ends[j]):
            v, to = _grouped(_lse(a[r.start[x]][:, :, None] + moves[None, :, 1:], 1) + s[x], r.end[x])
            a[to, 1:] = v
    for i in range(r.sizes.max() - 1, -1, -1):
        at = r.first[r.sizes > i] + i
        b[at] = moves[:, 0] + b[at + 1, :1]
        if len(x := starts[i]):
            v, to = _grouped(_lse(moves[None, :, 1:] + (s[x] + b[r.end[x], 1:])[:, None, :], 2), r.start[x])
            b[to] = np.logaddexp(b[to], v)
    z = _lse(a[last] + moves[:, 0], 1)
    zp = np.repeat(z, r.sizes + 1)
    gw, gm = np.zeros_like(weights), np.zeros_like(moves)
    inner = np.ones(r.places, bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    gm[:, 0] += np.exp(a[at] + moves[:, 0] + b[at + 1, :1] - zp[at, None]).sum(axis=0) + np.exp(a[last] + moves[:, 0] - z[:, None]).sum(axis=0)
    p = np.exp(a[r.start][:, :, None] + moves[None, :, 1:] + (s + b[r.end, 1:] - zp[r.start, None])[:, None, :])  # segment, label before, type
    gm[:, 1:] += p.sum(axis=0)
    mass = np.zeros((r.kinds, k - 1))
    np.add.at(mass, r.kind, p.sum(axis=1))
    label = np.zeros(r.places, np.int64)  # of the gold segment that ends at a place
    into, score = np.zeros(r.places, bool), 0.0
    for x, t in r.gold:
        mass[r.kind[x], t] -= 1
        score += s[x, t]
        label[r.end[x]] = t + 1
        into[r.start[x] + 1 : r.end[x] + 1] = True  # no outside token ends here
    for x, t in r.gold:
        y = label[r.start[x]]
        score += moves[y, t + 1]
        gm[y, t + 1] -= 1
    outside = np.flatnonzero(~into)
    outside = outside[~np.isin(outside, r.first)]
    np.add.at(gm[:, 0], label[outside - 1], -1.0)
    np.add.at(gm[:, 0], label[last], -1.0)
    score += moves[label[outside - 1], 0].sum() + moves[label[last], 0].sum()
    np.add.at(gw, r.feat, mass[r.owner])
    return float(z.sum() - score), gw, gm


def _word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghilmnoprstuvwzéäñ") for _ in range(r.randint(1, 9)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _hexes(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


def _card(r: random.Random) -> str:
    start, size = r.choice([("4", 16), ("4", 16), ("4", 13), ("5" + r.choice("12345"), 16), ("37", 15), ("34", 15), ("36", 14), ("6011", 16), ("65", 16), ("35", 16), ("62", 16), ("2" + r.choice("3456"), 16)])
    d = start + _digits(r, size - len(start) - 1)
    d += next(c for c in "0123456789" if luhn(d + c))
    return d if r.random() < 0.6 or len(d) != 16 else r.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))


def _iban(r: random.Random) -> str:
    land, rest = r.choice(["DE", "FR", "ES", "GB", "NL", "IT"]), _digits(r, r.choice([12, 14, 16, 18]))
    check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
    s = f"{land}{check:02d}{rest}"
    return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def _cap(r: random.Random) -> str:
    return "".join(r.choice("abcdefghilmnoprstuvwzéäñ") for _ in range(r.randint(3, 9))).capitalize()


def _more(r: random.Random) -> tuple[str, str | None, str]:
    """Kinds that need their surroundings, and what looks like them."""
    d, cap = _digits, _cap
    case = r.randrange(16)
    day = r.choice([f"19{d(r, 2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/19{d(r, 2)}", f"{r.randint(1, 28)} {cap(r)} 20{d(r, 2)}", f"{cap(r)} {r.randint(1, 28)}, 19{d(r, 2)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.19{d(r, 2)}"])
    if case < 2:
        return "", "PERSON", f"{r.choice(['Mr', 'Mrs', 'Ms', 'Dr', 'Prof', 'Herr', 'Frau', 'Señora', 'Mme'])}{r.choice(['.', '.', ''])} {' '.join(cap(r) for _ in range(r.randint(1, 3)))}"
    if case == 2:
        return r.choice(["name: ", "Name: ", "contact: ", "patient: ", "customer="]), "PERSON", " ".join(cap(r) for _ in range(r.randint(2, 3)))
    if case < 5:
        return "", "ADDRESS", r.choice([f"{r.randint(1, 999)}{r.choice(['', '', 'B'])} {' '.join(cap(r) for _ in range(r.randint(1, 2)))} {r.choice(['Street', 'St', 'Avenue', 'Ave', 'Road', 'Rd', 'Lane', 'Drive', 'Boulevard', 'Court', 'Way', 'Square'])}", f"{r.randint(1, 99)}{r.choice([',', ''])} {r.choice(['rue', 'avenue', 'boulevard', 'place'])} {r.choice(['', 'de ', 'de la ', 'du '])}{cap(r)}"])
    if case < 7:
        return r.choice(["born ", "born on ", "dob ", "dob: ", "geboren am ", "nacida el ", "née le ", "birth: ", "birthday "]), "BIRTH", day
    if case < 9:
        return r.choice(["", "", "on ", "until ", "since "]), None, day
    if case == 9:
        return r.choice(["ssn ", "ssn: "]), "SSN", r.choice([d(r, 9), f"{d(r, 3)} {d(r, 2)} {d(r, 4)}"])
    if case == 10:
        return r.choice(["phone ", "tel ", "call ", "tel: "]), "PHONE", d(r, 10)
    if case == 11:
        return r.choice(["", "ip ", "host "]), "IP", r.choice([":".join(_hexes(r, 4) for _ in range(8)), f"2001:db8::{_hexes(r, 4)}:{_hexes(r, 3)}", f"fe80::{_hexes(r, 4)}:{_hexes(r, 4)}:{_hexes(r, 4)}:{_hexes(r, 4)}"])
    if case == 12:
        return r.choice(["email ", "mail: "]), "EMAIL", f"{_word(r)}@{''.join(r.choice('abcdefgh') for _ in range(6))}"
    if case == 13:
        letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(r.randint(6, 24)))
        return r.choice(["password=", "token=", "secret = ", 'pwd="', 'password: "']), "SECRET", letters
    if case == 14:
        return r.choice(["password: ", "secret: ", "token: "]), None, "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(6, 12)))
    return r.choice(["password: ", "password=", "pwd: "]), "SECRET", "".join(r.choice("abcdefghijk") for _ in range(r.randint(4, 8))) + d(r, r.randint(1, 4)) + r.choice(["", "!", "x"])


def _example(r: random.Random) -> tuple[str, str | None, str]:
    """(text before, type or None, text): an entity or a number that is none."""
    if r.random() < 0.35:
        return _more(r)
    w, d = _word(r), _digits
    case = r.randrange(28)
    if case < 3:
        local = r.choice([f"{w}.{d(r, 2)}", w, f"{w}.{_word(r)}", f"{w}_{d(r, 3)}", f"{w}+{_word(r)}"])
        return r.choice(["", "", "email ", "mail: "]), "EMAIL", f"{local}@{r.choice(['', 'mail.', 'x-'])}{_word(r)}{r.choice(['', d(r, 1)])}.{r.choice(['com', 'org', 'example.com', 'co.uk', 'de'])}"
    if case < 6:
        a, b, c = d(r, 3), d(r, 3), d(r, 4)
        return r.choice(["", "", "tel ", "call "]), "PHONE", r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+49 {a} {c}{d(r, 3)}", f"+33 {d(r, 1)} {d(r, 2)} {d(r, 2)} {d(r, 2)} {d(r, 2)}", f"+34 {a} {b} {d(r, 3)}", f"+44 20 {c} {d(r, 4)}"])
    if case < 8:
        return r.choice(["", "", "ip ", "host "]), "IP", ".".join(str(r.randint(0, 255)) for _ in range(4))
    if case < 10:
        return r.choice(["", "", "card "]), "CARD", _card(r)
    if case == 10:
        return r.choice(["", "ssn ", "ssn: "]), "SSN", f"{d(r, 3)}-{d(r, 2)}-{d(r, 4)}"
    if case == 11:
        return r.choice(["", "iban "]), "IBAN", _iban(r)
    if case == 12:
        return "", "SECRET", r.choice(["AKIA", "ASIA"]) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) if r.random() < 0.7 else "ghp_" + _hexes(r, 36)
    if case < 16:
        value = _hexes(r, r.choice([16, 18, 20, 32, 40, 64])) if r.random() < 0.7 else "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHJKLM0123456789") for _ in range(r.randint(18, 40))) + "7q"
        return r.choice(['token = "', "token=", "password=", "secret: ", 'key = "', "apikey=", "pwd=", 'password: "']), "SECRET", value
    a = r.choice([f"{d(r, 1)}.{d(r, 1)}", d(r, r.randint(1, 12)), f"20{d(r, 2)}-{d(r, 2)}-{d(r, 2)}", f"{d(r, 2)}/{d(r, 2)}/20{d(r, 2)}", f"{d(r, 2)}:{d(r, 2)}", f"${d(r, 2)}.{d(r, 2)}", f"#{d(r, 6)}", f"978-{d(r, 1)}-{d(r, 2)}-{d(r, 6)}-{d(r, 1)}", f"{d(r, 1)}.{d(r, 1)}.{d(r, 2)}", f"1.{d(r, 1)}.{d(r, 1)}.{d(r, 1)}.{d(r, 2)}", f"{d(r, 1)},{d(r, 3)},{d(r, 3)}", f"@{w}", f"{w}{d(r, 2)}", f"{d(r, 2)}%", f"{d(r, 1)}x{d(r, 1)}", f"v{d(r, 1)}.{d(r, 2)}", f"{_hexes(r, 8)}-{_hexes(r, 4)}-{_hexes(r, 4)}-{_hexes(r, 4)}-{_hexes(r, 12)}", f"{d(r, 3)}-{d(r, 3)}", f"{d(r, 2)}-{d(r, 2)}-{d(r, 2)}"])
    if r.random() < 0.12:
        a = _hexes(r, 40)
        return r.choice(["commit ", "sha "]), None, a
    if r.random() < 0.08:
        bad = r.choice("01789") + _digits(r, 14)  # no issuer's
        return r.choice(["order ", ""]), None, bad + r.choice([next(c for c in "0123456789" if luhn(bad + c)), r.choice("0123456789")])
    if r.random() < 0.08:
        bad = _digits(r, 16)
        return r.choice(["order ", ""]), None, bad if not luhn(bad) else bad[:-1] + str((int(bad[-1]) + 1) % 10)
    return r.choice(["", "", "version ", "order ", "isbn "]), None, a


def generated(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences of invented words with entities and other numbers at known places."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = _word(r), []
        for _ in range(r.randint(1, 3)):
            before, kind, value = _example(r)
            text += " " + "".join(_word(r) + " " for _ in range(r.choice([0, 1, 1, 2, 3]))) + before
            if kind:
                spans.append((len(text), len(text) + len(value), kind))
            text += value
            if kind is None and before in ("password: ", "secret: ", "token: "):
                text += " " + _word(r)  # prose about secrets
            if before.endswith('"'):
                text += '"'
            text += r.choice(["", "", "", ".", ",", "%%%", "###", ")", ";", "!"])
        out.append((text + r.choice(["", " " + _word(r)]), spans))
    return out


def fit(sentences: list, steps: int = 60, rate: float = 0.3, l2: float = 0.02) -> SemiCRF:
    """Maximum likelihood by Adam, full batch."""
    index: dict[str, int] = {}
    r = Regions(sentences, index)
    k = len(TYPES) + 1
    weights, moves = np.zeros((len(index), k - 1)), np.zeros((k, k))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    for t in range(1, steps + 1):
        _, gw, gm = likelihood(r, weights, moves)
        gm[0, 0] = 0  # outside after outside counts nothing, which lets regions be decoded apart
        for x, g, (m, v) in zip((weights, moves), (gw + l2 * weights, gm + l2 * moves), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return SemiCRF(index, weights, moves)


_MODEL: list[SemiCRF] = []


def trained(sentences: int = 500, steps: int = 40) -> SemiCRF:
    """The model of the generated sentences, made once per driver."""
    if not _MODEL:
        _MODEL.append(fit(generated(sentences), steps))
    return _MODEL[0]


def redact(docs: DataFrame, model: SemiCRF | None = None, text_col: str = "text") -> DataFrame:
    """Put [TYPE] in place of each entity; adds n_spans and spans of the original text."""
    new = [("n_spans", "INT"), ("spans", "ARRAY<STRUCT<start: INT, end: INT, type: STRING>>")]
    if text_col.lower() in [n for n, _ in new]:
        raise ValueError(f"the text's column can't be named {text_col}, as a result is")
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    at = place(docs, text_col, [n for n, _ in new])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        crf = shared.value
        data, off = utf8(b.column(at))
        worth = np.diff(np.searchsorted(np.flatnonzero(_TRIGGER[data]), off)) > 0
        rows = np.flatnonzero(worth | pc.fill_null(pc.match_substring_regex(b.column(at), _WORTH), False).to_numpy(zero_copy_only=False))
        texts, spans = b.column(at), [[] for _ in range(b.num_rows)]
        new, done = [], 0
        for i in rows.tolist():
            text = texts[i].as_py()
            found = crf.decode(text)
            if not found:
                continue
            spans[i] = [{"start": x, "end": y, "type": t} for x, y, t in found]
            out, last = [], 0
            for x, y, t in found:
                out += [text[last:x], f"[{t}]"]
                last = y
            new += [texts.slice(done, i - done), pa.array(["".join(out) + text[last:]], texts.type)]
            done = i + 1
        cols = [*b.columns, pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, span)]
        cols[at] = pa.concat_arrays([*new, texts.slice(done)]) if new else texts
        return cols

    return with_arrow(docs, make, new)
