"""Personal data: exact patterns, and a semi-Markov conditional random field for what they leave.

E-mail addresses, IP addresses, card numbers and phone numbers in plain form are fixed patterns. For what is weaker
(digits in other groupings, spelled-out addresses, account codes, passwords and keys) a semi-Markov CRF scores
whole segments by features of the entire span, and dynamic programming over segments of bounded length chooses
boundaries and types together. Its segments are defined so that each holds evidence which a pattern finds, so
looking only around such evidence loses none. Its spans get kinds of their own and never replace a plain one.
The model is trained here on sentences made from a grammar of such spans and of look-alikes.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import DataFrame

from .tables import map_rows

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the CRF adds: 0 is text outside of any.
TYPES = ("", "spelled_email", "local_phone", "national_id", "iban", "secret")
#: Tokens of the longest spelled address or number.
MOST_TOKENS = 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """As ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds them, looking only around each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Plain spans by kind, then start; leftmost and non-overlapping within each kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- the semi-Markov CRF --------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\sA-Za-z0-9]|\s{8,}")
_AT = re.compile(r"(?i)\b(?:at|arroba|chez)\b")
_DIGITS = re.compile(r"[0-9](?:[\s().\-/]*[0-9]){6,}")
_CODE = re.compile(r"[A-Za-z0-9]{15,}")
_SPACED_CODE = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]*(?:\s+[A-Z0-9]+)+")
# Words that stand for signs, and words that announce a kind of number.
ATS, DOTS = frozenset(("at", "arroba", "chez")), frozenset(("dot", "punto", "point", "punkt"))
PHONE_WORDS = frozenset(("phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "tél", "teléfono"))
ID_WORDS = frozenset(("id", "ssn", "nif", "dni", "passport", "ausweis", "insurance"))
SECRET_WORDS = frozenset(("password", "passwd", "pwd", "passwort", "contraseña", "secret", "token", "key", "apikey", "credential"))
SPELLED_SIGNS, NUMBER_SIGNS = frozenset("[](){}._-+%"), frozenset("().-/")
#: Letters and signs of the longest spelled address, and characters around evidence that a zone takes in: more than
#: any entity has with its context. Wide gaps are tokens of their own, which no entity holds.
MOST_SPELLED, MOST_CHARS = 200, 640
FEATURES = 44


def candidates(tokens: list[str], glued: list[bool]) -> dict[tuple[int, int], frozenset[int]]:
    """The segments that may be an entity, and of which types: the model's states beside text outside.

    A spelled address holds an at-word and after it a dot or a word for it between parts of names. A phone number or
    id has 7 to 11 digits and signs between them, an account code two capitals, two digits and 15 to 34 characters
    in all; a secret is a whole run of 16 to 64 ASCII letters and digits with both.
    """
    out: dict[tuple[int, int], set[int]] = {}
    n = len(tokens)
    digit = [t[0] in "0123456789" for t in tokens]
    alnum = [t[0].isalnum() for t in tokens]
    i = 0
    while i < n:  # runs of digits and the signs between them
        j = i
        while j < n and (digit[j] or tokens[j] in NUMBER_SIGNS):
            j += 1
        for a in range(i, j):
            if digit[a] or tokens[a] == "(":
                total = 0
                for b in range(a + 1, min(j, a + MOST_TOKENS) + 1):
                    if digit[b - 1]:
                        total += len(tokens[b - 1])
                        if total > 11:
                            break
                        if total >= 7:
                            out.setdefault((a, b), set()).update((2, 3))
        i = max(j, i + 1)
    i = 0
    while i < n:  # runs of letters and digits without a space
        j = i + 1
        if alnum[i]:
            while j < n and alnum[j] and glued[j]:
                j += 1
            run = "".join(tokens[i:j])
            if 16 <= len(run) <= 64 and run.isascii() and any(digit[i:j]) and not all(digit[i:j]):
                out.setdefault((i, j), set()).add(5)
        i = j
    for a in range(n - 1):
        if len(tokens[a]) == 2 and tokens[a].isascii() and tokens[a].isalpha() and tokens[a].isupper() and digit[a + 1] and glued[a + 1] and len(tokens[a + 1]) >= 2:
            size = 0
            for b in range(a + 1, min(n, a + 2 * MOST_TOKENS) + 1):
                t = tokens[b - 1]
                if not (digit[b - 1] or (t.isascii() and t.isalpha() and t.isupper())):
                    break
                size += len(t)
                if size > 34:
                    break
                if size >= 15 and not (b < n and glued[b] and alnum[b]):
                    out.setdefault((a, b), set()).add(4)
    for i, t in enumerate(tokens):
        if t.lower() in ATS:
            fits = lambda k: alnum[k] or tokens[k] in SPELLED_SIGNS
            left, right = i, i + 1
            while left > 0 and i - left < MOST_TOKENS and fits(left - 1):
                left -= 1
            while right < n and right - i < MOST_TOKENS and fits(right):
                right += 1
            dots = [k for k in range(i + 2, right - 1) if tokens[k].lower() in DOTS or (tokens[k] == "." and glued[k] and glued[k + 1])]
            if dots:
                for a in range(left, i):
                    for b in range(dots[0] + 2, min(right, a + MOST_TOKENS) + 1):
                        if alnum[a] and alnum[b - 1] and sum(map(len, tokens[a:b])) <= MOST_SPELLED:
                            out.setdefault((a, b), set()).add(1)
    return {k: frozenset(v) for k, v in out.items()}


def features(tokens: list[str], glued: list[bool], a: int, b: int) -> np.ndarray:
    """Of the whole span tokens[a:b]; glued: whether a token follows its predecessor without space."""
    span = tokens[a:b]
    low = [t.lower() for t in span]
    digits = [t for t in span if t[0] in "0123456789"]
    groups = tuple(len(t) for t in digits)
    total = sum(groups)
    alphas = [t for t in span if t[0].isalpha()]
    others = [t for t in span if not t[0].isalnum()]
    joined = "".join(span)
    at = [i for i, t in enumerate(low) if t in ATS]
    dots = [i for i, t in enumerate(low) if t in DOTS or (t == "." and 0 < i < b - a - 1 and glued[a + i] and glued[a + i + 1])]
    spelled = [i for i, t in enumerate(low) if t in DOTS]
    spaces = sum(not g for g in glued[a + 1 : b])
    bracketed = sum(t in "[](){}" for t in others)
    before = [t.lower() for t in tokens[max(0, a - 5) : a]]
    f = np.zeros(FEATURES)
    f[0] = 1
    f[1] = b - a == 1
    f[2] = min(b - a, MOST_TOKENS) / 8
    f[3] = len(at) == 1 and bool(dots) and at[0] < dots[-1]
    f[4] = len(at) > 1
    f[5] = bool(at) and not dots
    f[6] = bool(alphas) and alphas[-1].lower() in ("com", "org", "net", "edu", "de", "fr", "es", "io", "co")
    f[7] = span[0][0].isalnum()
    f[8] = span[-1][0].isalnum()
    f[9] = bool(at) and len(alphas) - len(at) - len(spelled) >= 5
    f[10] = groups == (3, 3, 4)
    f[11] = groups == (3, 2, 4)
    f[12] = total == 10
    f[13] = total == 9
    f[14] = total in (7, 8)
    f[15] = total > 11
    f[16] = bool(digits) and not alphas
    f[17] = bool(digits) and bool(alphas)
    f[18] = "-" in others
    f[19] = "(" in others and ")" in others and span[0] == "("
    f[20] = "." in others
    f[21] = "/" in others
    f[22] = bool(others) and not set(others) <= set("()-./[]{}_")
    f[23] = len(joined) >= 15 and joined[:2].isalpha() and joined[:2].isupper() and joined[2:4].isdigit() and joined.isalnum()
    f[24] = spaces > 6
    f[25] = not digits and not at
    f[26] = bool(before) and before[-1] in ("+", "-", ".", "/", "#")
    f[27] = b < len(tokens) and tokens[b][0].isdigit() and glued[b]
    f[28] = b < len(tokens) and tokens[b] in "-./" and glued[b] and b + 1 < len(tokens) and glued[b + 1]
    f[29] = bracketed >= 2 and bool(at)
    f[30] = a > 0 and tokens[a - 1][0].isdigit() and glued[a]
    f[31] = len(digits) == 1 and b - a == 1
    f[32] = total == 16 or total == 15
    f[33] = len(alphas) > len(at) + len(spelled) + 4
    f[34] = any(t in PHONE_WORDS for t in before[-3:])
    f[35] = any(t in ID_WORDS for t in before[-3:])
    f[36] = any(t in SECRET_WORDS for t in before)
    f[37] = any(t in '="\':' for t in before[-3:])
    f[38] = len(joined) == 20 and joined[:4] in ("AKIA", "ASIA") and joined.isalnum() and joined.isupper()
    f[39] = len(joined) >= 16 and bool(digits) and bool(alphas) and set(joined) <= set("0123456789abcdef")
    f[40] = len(joined) >= 16 and len(digits) >= 3 and not others
    f[41] = len(joined) >= 16 and len(set(joined)) / len(joined) > 0.4
    f[42] = b - a > 8
    f[43] = bool(spelled) or bracketed >= 2
    return f


def segments(tokens: list[str], glued: list[bool]) -> tuple[np.ndarray, dict[tuple[int, int], int], np.ndarray]:
    """Features of every segment, their numbers, and which types each may have: one token outside, or a candidate."""
    found = candidates(tokens, glued)
    spans = sorted({*((i, i + 1) for i in range(len(tokens))), *found})
    x = np.array([features(tokens, glued, a, b) for a, b in spans]).reshape(-1, FEATURES)
    may = np.zeros((len(spans), len(TYPES)), bool)
    for k, (a, b) in enumerate(spans):
        may[k, 0] = b == a + 1
        may[k, list(found.get((a, b), ()))] = True
    return x, {s: k for k, s in enumerate(spans)}, may


def _by_end(n: int, index: dict[tuple[int, int], int]) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for (a, b), k in index.items():
        out[b].append((a, k))
    return out


def _lse(x: np.ndarray) -> float:
    m = x.max()
    return m + np.log(np.exp(x - m).sum())


def decode(tokens: list[str], glued: list[bool], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's entities: (first token, end token, type).

    Tokens that no candidate covers are outside in every segmentation, so only those that one covers are scored.
    """
    found = candidates(tokens, glued)
    if not found:
        return []
    outside = np.zeros(len(tokens))
    covered = sorted({i for a, b in found for i in range(a, b)})
    outside[covered] = np.array([features(tokens, glued, i, i + 1) for i in covered]) @ weights[0]
    ends: dict[int, list] = {}
    for (a, b), types in found.items():
        scores = weights @ features(tokens, glued, a, b)
        kind = max(sorted(types), key=lambda t: scores[t])
        ends.setdefault(b, []).append((a, kind, scores[kind]))
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for b in range(1, len(tokens) + 1):
        best[b] = best[b - 1] + outside[b - 1]
        for a, kind, score in ends.get(b, ()):
            if best[a] + score > best[b]:
                best[b], back[b] = best[a] + score, (a, kind)
    out, at = [], len(tokens)
    while at:
        if back[at]:
            out.append((back[at][0], at, back[at][1]))
            at = back[at][0]
        else:
            at -= 1
    return out[::-1]


def _sentences(rng: random.Random, n: int):
    """Texts with gold entities, from a grammar of spans and look-alikes."""
    syllables = "an be co de el fa go hi ion ka lo mi nu or pe ra so ti un ve wo xa yo ze".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k - 2)) + rng.choice(["a1", "7f", "c3"])
    base32 = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k - 1)) + rng.choice("234567")

    def entity(t: int) -> tuple[str, str]:
        """What announces it and the entity."""
        if t == 1:
            l, r = rng.choice([(" ", " "), ("[", "]"), (" [", "] "), ("(", ")"), (" (", ") ")])
            tld = rng.choice(["com", "org", "net", "de", "fr", "es"])
            host = word() + (rng.choice(["", digits(1)]))
            first = word() + rng.choice(["", digits(2), f".{word()}"])
            at, dot = rng.choice([("at", "dot"), ("at", "dot"), ("AT", "Dot"), ("At", "DOT"), ("arroba", "punto"), ("chez", "point")])
            return "", f"{first}{l}{at}{r}{host}" + (f"{l}{dot}{r}{tld}" if rng.random() < 0.7 else f".{tld}")
        if t == 2:
            if rng.random() < 0.25:
                return rng.choice(["call ", "tel ", "Phone: ", "mobile "]), digits(10)
            return "", rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}"])
        if t == 3:
            return (rng.choice(["ssn ", "ID: ", "passport "]), digits(9)) if rng.random() < 0.25 else ("", f"{digits(3)}-{digits(2)}-{digits(4)}")
        if t == 4:
            return "", f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{digits(2)}" + rng.choice(["", " "]).join(["", *(digits(4) for _ in range(rng.randint(3, 5)))])
        if t == 5:
            if rng.random() < 0.35:
                return "", f"{rng.choice(['AKIA', 'ASIA'])}{base32(16)}"
            name, sign = rng.choice(["password", "passwd", "token", "secret", "api_key", "key"]), rng.choice(["=", " = ", ": ", '="', ' = "', ': "'])
            return f"{name}{sign}", rng.choice([hexes(18), hexes(32), hexes(40), base32(24), hexes(20)])
        return "", rng.choice([
            f"{rng.randint(1900, 2030)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(3)}.{digits(2)}.{digits(2)}.{digits(3)}",
            f"{word()} at {word()} dot", f"at the {word()}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", digits(rng.randint(5, 17)), f"{digits(2)}.{digits(3)}.{digits(3)}",
            f"{digits(3)}-{digits(3)}-{digits(4)}-{digits(3)}", f"{digits(4)}-{digits(4)}", f"#{digits(3)}-{digits(3)}-{digits(3)}", f"AK{rng.choice('IA')}{word().upper()}{digits(3)}{word().upper()}",
            f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(1)},{digits(3)},{digits(3)}", f"dot {word()} at", f"{word()} at {word()}", f"v{digits(1)}.{digits(2)}.{digits(4)}",
            f"order {digits(9)}", f"{digits(10)} {word()}", f"at {word()} {word()} {digits(1)}.{digits(2)}", f"{word()}{word()}{word()}{word()}{word()}{word()}{digits(2)}", f"commit {hexes(40)}", f"{word()}_{word()}{digits(4)}{word()}{word()}{word()}{word()}",
        ])

    for _ in range(n):
        text, gold = " ".join(word() for _ in range(rng.randint(0, 3))), []
        for t in rng.sample([0, 0, 0, 0, 1, 2, 3, 4, 5], rng.randint(1, 2)):
            announced, e = entity(t)
            text += " " * bool(text) + announced
            if t:
                gold.append((len(text), len(text) + len(e), t))
            text += e + ('"' if announced.endswith('"') else rng.choice(["", ",", "."])) + " " + " ".join(word() for _ in range(rng.randint(1, 3)))
        yield text, gold


def tokenize(text: str) -> tuple[list[str], list[int], list[bool]]:
    found = list(_TOKEN.finditer(text))
    glued = [i > 0 and found[i - 1].end() == m.start() for i, m in enumerate(found)]
    return [m[0] for m in found], [m.start() for m in found], glued


@functools.lru_cache(1)
def train(sentences: int = 320, steps: int = 60, seed: int = 7) -> np.ndarray:
    """Weights (type, feature) by Adam on the log-likelihood; forward-backward over segments."""
    data = []
    for text, gold in _sentences(random.Random(seed), sentences):
        tokens, starts, glued = tokenize(text)
        x, index, may = segments(tokens, glued)
        at = {s: i for i, s in enumerate(starts)}
        ends = {s + len(t): i + 1 for i, (s, t) in enumerate(zip(starts, tokens, strict=True))}
        y, inside = [], set()
        for a, b, t in gold:
            if a in at and b in ends and (at[a], ends[b]) in index and may[index[at[a], ends[b]], t]:
                y.append((index[at[a], ends[b]], t))
                inside |= set(range(at[a], ends[b]))
        y += [(index[i, i + 1], 0) for i in range(len(tokens)) if i not in inside]
        starts_at: list[list[tuple[int, int]]] = [[] for _ in range(len(tokens) + 1)]
        for (a, b), k in index.items():
            starts_at[a].append((b, k))
        data.append((x, np.where(may, 0.0, -1e9), np.array(list(index)), _by_end(len(tokens), index), starts_at, y, len(tokens)))
    w = np.zeros((len(TYPES), FEATURES))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        grad = 0.02 * w
        for x, barred, keys, by_end, by_start, y, n in data:
            scores = x @ w.T + barred
            flat = scores.max(1) + np.log(np.exp(scores - scores.max(1, keepdims=True)).sum(1))
            fwd, bwd = np.full(n + 1, -1e18), np.full(n + 1, -1e18)
            fwd[0] = bwd[n] = 0
            for b in range(1, n + 1):
                fwd[b] = _lse(np.array([fwd[a] + flat[k] for a, k in by_end[b]]))
            for a in range(n - 1, -1, -1):
                bwd[a] = _lse(np.array([bwd[b] + flat[k] for b, k in by_start[a]]))
            p = np.exp(fwd[keys[:, 0]][:, None] + scores + bwd[keys[:, 1]][:, None] - fwd[n])
            for k, t in y:
                p[k, t] -= 1
            grad = grad + p.T @ x
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w


def _evidence(text: str) -> list[tuple[int, int]]:
    """Places that every candidate of ``candidates`` holds one of."""
    hits = [m.span() for m in _DIGITS.finditer(text)] if _DIGIT.search(text) else []
    for m in _CODE.finditer(text) if hits or _DIGIT.search(text) else ():
        if not m[0].isalpha() and not m[0].isdigit():
            hits.append(m.span())
    hits += [m.span() for m in _SPACED_CODE.finditer(text) if sum(map(str.isalnum, m[0])) >= 15]
    for m in _AT.finditer(text):
        for k, t in zip(range(MOST_TOKENS), _TOKEN.finditer(text, m.end()), strict=False):
            if not (t[0][0].isalnum() or t[0] in SPELLED_SIGNS):
                break
            if k and (t[0].lower() in DOTS or (t[0] == "." and text[t.start() - 1].isalnum() and text[t.end() : t.end() + 1].isalnum())):
                hits.append((m.start(), t.end()))
                break
    return hits


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches that hold all candidates and what their features see, merged where they meet.

    Nothing outside them is a candidate, so decoding them gives what decoding the whole text gives.
    """
    out: list[list[int]] = []
    for a, b in sorted(_evidence(text)):
        a, b = max(0, a - MOST_CHARS), min(len(text), b + MOST_CHARS)
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def added_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """What the CRF finds beside the plain spans."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    first = [a for a, _ in taken]
    reach = list(itertools.accumulate((b for _, b in taken), max))
    for a, b in zones(text):
        tokens, starts, glued = tokenize(text[a:b])
        for i, j, t in decode(tokens, glued, weights):
            s, e = a + starts[i], a + starts[j - 1] + len(tokens[j - 1])
            before = bisect.bisect_left(first, e)  # plain spans that start before this one ends
            if not before or reach[before - 1] <= s:
                out.append((TYPES[t], s, e))
    order = {k: i for i, k in enumerate(TYPES)}
    return sorted(out, key=lambda x: (order[x[0]], x[1]))


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the counts of plain spans by kind, and all spans as kind, start, end (code points, end exclusive).

    A null or empty text has no spans; one of any length is read whole, its cost linear in it. Of the CRF's equally
    good segmentations the one with fewer entities is taken; its spans never overlap plain ones, which come first.
    Repeated rows stay, an empty table gives an empty result, other columns are ignored, whatever their names.
    """
    weights = train()
    slim = docs.select(f"`{id_col}`", f"`{text_col}`")
    kind = dict(docs.dtypes)[id_col]

    def run(cols):
        out = {k: [] for k in ("base", "spans", *KINDS)}
        for text in cols[text_col]:
            base = base_spans(text or "")
            spans = base + added_spans(text or "", base, weights)
            for k in KINDS:
                out[k].append(sum(s[0] == k for s in base))
            out["base"].append(len(base))
            out["spans"].append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
        yield {id_col: cols[id_col], **out}

    return map_rows(slim, run, f"`{id_col}` {kind}, email bigint, ip bigint, card bigint, phone bigint, base int, spans array<struct<kind:string,start:int,end:int>>")


def sha256(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document; spans as kind:start:end."""
    from pyspark.sql import functions as F

    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id", *[F.col(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.slice(shown, F.lit(1), F.col("base")), ","), 256).alias("base_sha256"),
        F.array_join(shown, ",").alias("spans"), F.size("spans").cast("long").alias("n_spans"),
    )
