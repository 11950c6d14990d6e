"""Personal data: fixed patterns, and spans added by weak supervision.

Candidates beyond the patterns are secrets, account numbers, IBANs, names of people and street addresses. Labelers (shape, gazetteer: lists of
given names, street words, country codes of IBANs, calling codes, issuers of cards and keys, domains; context: the words before; quoting;
variety of characters) vote for, against or not at all on every candidate. The counts of all vote patterns of all documents, a small
table, go into expectation-maximisation, which estimates how reliable each labeler is and
how likely each pattern is personal data; on these soft labels a logistic span classifier is
trained, also from pattern counts. It decides on candidates beyond the fixed patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "account", "iban", "name", "address")
BASE = KINDS[:4]
SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# possessive runs: a run of digits is read once, however long
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# gazetteers
GIVEN_NAMES = frozenset(
    """Alexander Alice Amelia Ana Andrea Andrew Angela Anna Anne Antonio Barbara Benjamin Carlos Carmen Caroline Catherine Charles Charlotte Christian Christine
    Claudia Clara Daniel David Diego Dieter Dorothy Eduardo Edward Elena Elizabeth Emily Emma Eric Ernst Eva Felix Fernando Francisco Frank Friedrich Georg George
    Gabriel Hannah Hans Heinrich Helen Helga Henri Henry Ines Isabel Jacques James Jane Javier Jean Jennifer Jessica Joachim Johann John Jorge Joseph José Juan
    Julia Julien Jürgen Karen Karl Katharina Klaus Laura Lena Linda Louis Louise Lucas Lucía Luis Manuel Marc Margaret Maria Marie Mario Mark Martin Martha Mary
    Matthew Max Michael Michel Miguel Monika Nancy Nicolas Nicole Olivia Pablo Patricia Paul Pedro Peter Philipp Philippe Pierre Rachel Rafael Ralf Richard Robert Rosa Ruth
    Samuel Sandra Sara Sarah Sebastian Sofia Sophie Stefan Stephen Susan Susanne Sylvie Teresa Thomas Ursula Uwe Victor Walter Werner William Wolfgang Yves""".split()
)
STREET_WORDS = "Street St Road Rd Avenue Ave Lane Ln Boulevard Blvd Drive Court Square Terrace".split()
STREET_ENDS = "straße strasse weg platz gasse allee ufer damm".split()
STREET_STARTS = "rue avenue boulevard place chemin impasse allée quai calle avenida plaza paseo camino".split()
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
KEY_STARTS = ("sk", "pk", "ghp", "gho", "AKIA", "ASIA", "AIza", "xoxb", "xoxp", "eyJ", "glpat", "SG")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "61", "81", "82", "86", "90", "91")
CARD_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "2221", "6011", "65", "35", "30", "36", "38")
DOMAINS = frozenset("com org net edu gov info io de fr es it uk eu ch at nl pl ru br mx ar ca au jp test example".split())

# each begins with a set of characters, so that a text without them is passed over fast; that a word begins there is tested afterwards
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CAPITALS = re.compile(r"[A-ZÄÖÜÉ][a-zà-ÿ]+(?=( (?:[A-ZÄÖÜÉ]\. )?[A-ZÄÖÜÉ][a-zà-ÿ]+(?:-[A-ZÄÖÜÉ][a-zà-ÿ]+)?)(?!\w))")
_ADDRESSES = [
    re.compile(rf"[0-9]{{1,5}}[a-z]? (?:[A-Z][a-z]+ ){{1,3}}(?:{'|'.join(STREET_WORDS)})(?!\w)"),
    re.compile(rf"[A-ZÄÖÜ][a-zäöüß]*(?:{'|'.join(STREET_ENDS)}) [0-9]{{1,4}}[a-z]?(?!\w)"),
    re.compile(rf"[0-9]{{1,4}},? (?:{'|'.join(STREET_STARTS)}) [A-Za-zà-ÿ' -]{{3,40}}?[a-zà-ÿ](?=[,.;\n]|$)"),
    re.compile(rf"[{''.join(sorted({w[0].upper() for w in STREET_STARTS}))}](?:{'|'.join(w[1:] for w in STREET_STARTS)}) [A-Z][a-zà-ÿ]+(?: [A-Za-zà-ÿ]+){{0,3}},? [0-9]{{1,4}}(?!\w)"),
]
#: What a text has to hold for a name to be looked for: two words with capitals in a row. The list of names is asked afterwards.
NAMED = r"[A-ZÄÖÜÉ][a-zà-ÿ]++ [A-ZÄÖÜÉ]"
_CUES = {
    "email": re.compile(r"(mail|contact|write|correo|courriel|kontakt)[^\n]{0,12}$", re.I),
    "ip": re.compile(r"(ip|host|server|address|from|client|login)[^\n]{0,12}$", re.I),
    "phone": re.compile(r"(tel|phone|call|fax|mobil|móvil|handy)[^\n]{0,12}$", re.I),
    "name": re.compile(r"(name|nombre|nom|mr\.?|mrs\.?|ms\.?|dr\.?|herr|frau|señora?|monsieur|madame|signed|author|by|contact)[:\s]{1,3}$", re.I),
    "address": re.compile(r"(address|adresse|dirección|lives|wohnt|street|at|ship to|anschrift)[^\n]{0,12}$", re.I),
}
_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}")
_HEX = re.compile(r"[0-9a-fA-F]+")
_SECRET_WORDS = re.compile(r"(token|secret|key|passw|auth|bearer|credential)[^\n]{0,12}$", re.I)
_NUMBER_WORDS = re.compile(r"(card|account|konto|cuenta|compte|visa|iban)[^\n]{0,12}$", re.I)
_HARMLESS = re.compile(r"(version|license|isbn|issn|commit|sha|build|page)[^\n]{0,8}$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban(value: str) -> bool:
    """Whether the check digits of an account number hold: the number, its first four characters last, is 1 modulo 97."""
    bare = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def listed(kind: str, value: str) -> int:
    """The vote of the gazetteers: 1 where a list knows the value, 2 where it ought to and does not, 0 where there is no such list."""
    if kind == "iban":
        return 1 if IBAN_LENGTHS.get(value[:2]) == len(value.replace(" ", "")) else 2
    if kind in ("name", "address"):
        return 1
    if kind == "email":
        return 1 if value.rsplit(".", 1)[-1].lower() in DOMAINS else 0
    if kind == "phone":
        return 1 if value[1:].startswith(CALLING_CODES) else 2
    if kind in ("card", "account"):
        return 1 if value.startswith(CARD_ISSUERS) else 2
    return 1 if kind == "secret" and value.startswith(KEY_STARTS) else 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a run of local characters up to an '@', then a dotted domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = end = m.end()
            yield start, end
        at, done = text.find("@", end), max(done, at + 1 if end == at + 1 else done)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns; matches that fail their test are dropped and not tried again."""
    found = [(a, "email", b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), "phone", m.end()))
    return found


def more_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what may be an IBAN, a street address or a name; addresses of one text do not overlap each other."""
    begins = lambda m: not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")
    # what has not the length and the check digits of an IBAN may be a secret still
    yield from (("iban", *m.span()) for m in _IBAN.finditer(text) if begins(m) and listed("iban", m[0]) == 1 and iban(m[0]))
    end = 0
    for a, b in sorted(m.span() for pattern in _ADDRESSES for m in pattern.finditer(text) if begins(m)):
        if a >= end:
            yield "address", a, (end := b)
    yield from (("name", m.start(), m.end(1)) for m in _CAPITALS.finditer(text) if m[0] in GIVEN_NAMES and begins(m))


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]  # 1 for, 2 against, 0 none
    features: int  # bits


LABELERS = ("shape", "gazetteer", "context", "quoting", "variety")
FEATURES = 6


def candidates(text: str) -> list[Candidate]:
    """Base spans, and runs of letters and digits or long numbers that may be more."""
    base = base_spans(text)
    out = [_voted(text, kind, a, b, True) for a, kind, b in base]
    taken: set[int] = set()
    for kind, a, b in more_spans(text):
        out.append(_voted(text, kind, a, b, False))
        taken.add(a)
    cards = {(a, b) for a, kind, b in base if kind == "card"}
    for m in _RUN.finditer(text):
        run = m[0]
        if m.start() in taken:
            continue
        if run.isdigit():
            if len(run) <= 19 and m.span() not in cards:
                out.append(_voted(text, "account", m.start(), m.end(), False))
        elif any("0" <= c <= "9" for c in run):
            out.append(_voted(text, "secret", m.start(), m.end(), False))
    return out


def _voted(text: str, kind: str, start: int, end: int, base: bool) -> Candidate:
    value, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    digits = sum("0" <= c <= "9" for c in value)
    hexes = bool(_HEX.fullmatch(value))
    quoted = before[-1:] in "\"'`" and before != "" and after == before[-1:]
    assigned = bool(re.search(r"[=:]\s*[\"'`]?$", before))
    words = _SECRET_WORDS if kind == "secret" else _CUES.get(kind, _NUMBER_WORDS)
    if kind == "secret":
        shape = 1 if hexes and len(value) in (32, 40, 48, 56, 64) else 2 if value[:1].isupper() and digits <= 2 else 0
    elif kind == "account":
        shape = 1 if luhn(value) else 2
    elif kind == "iban":
        shape = 1 if iban(value) else 2
    else:
        shape = 1
    gazetteer = listed(kind, value)
    context = 2 if _HARMLESS.search(before) else 1 if assigned or words.search(before) else 0 if base or kind in ("iban", "address") else 2
    quoting = 1 if quoted else 0 if base else 2
    distinct = len(set(value.lower()))
    variety = 1 if distinct >= 9 else 2 if distinct <= 4 else 0
    features = hexes | quoted << 1 | assigned << 2 | (digits * 2 >= len(value)) << 3 | (len(value) >= 30) << 4 | (distinct >= 9) << 5
    return Candidate(kind, start, end, base, (shape, gazetteer, context, quoting, variety), int(features))


@dataclass(frozen=True)
class Model:
    """reliability: of each labeler, the chance of no vote, for and against, given data or not; weights: of the span classifier."""

    prior: tuple[float, ...]
    reliability: np.ndarray
    weights: np.ndarray

    def chance(self, kind: str, votes: tuple[int, ...], features: int) -> float:
        return float(1 / (1 + np.exp(-(inputs(kind, votes, features) @ self.weights))))


def inputs(kind: str, votes: tuple[int, ...], features: int) -> np.ndarray:
    x = np.zeros(len(KINDS) + 2 * len(LABELERS) + FEATURES)
    x[KINDS.index(kind)] = 1
    for k, v in enumerate(votes):
        if v:
            x[len(KINDS) + 2 * k + v - 1] = 1
    for b in range(FEATURES):
        x[len(KINDS) + 2 * len(LABELERS) + b] = features >> b & 1
    return x


def fit(patterns: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 60) -> Model | None:
    """From (kind, votes, features, count). None without candidates."""
    if not patterns:
        return None
    kinds = np.array([KINDS.index(p[0]) for p in patterns])
    votes = np.array([p[1] for p in patterns])
    counts = np.array([p[3] for p in patterns], float)
    base = kinds < len(BASE)
    # start from the majority; the fixed patterns are known to be data
    chance = np.clip(0.5 + 0.18 * ((votes == 1).sum(1) - (votes == 2).sum(1)), 0.05, 0.95)
    chance[base] = 0.98
    for _ in range(rounds):
        prior = np.array([(counts[kinds == k] @ chance[kinds == k] + 1) / (counts[kinds == k].sum() + 2) for k in range(len(KINDS))])
        table = np.zeros((2, len(LABELERS), 3))
        for y, w in enumerate((counts * (1 - chance), counts * chance)):
            for v in range(3):
                # a prior of a few votes: labelers are better than chance
                table[y, :, v] = w @ (votes == v) + (8 if v == 2 - y and v else 2)
        table /= table.sum(2, keepdims=True)
        odds = np.log(prior[kinds] / (1 - prior[kinds]))
        for j in range(len(LABELERS)):
            odds += np.log(table[1, j, votes[:, j]] / table[0, j, votes[:, j]])
        chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        chance[base] = np.maximum(chance[base], 0.98)
    x = np.array([inputs(k, v, f) for k, v, f, _ in patterns])
    weights = np.zeros(x.shape[1])
    scaled = counts / max(counts.sum(), 1) * min(counts.sum(), 10_000)
    for _ in range(25):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        grad = x.T @ (scaled * (chance - p)) - 0.05 * weights
        hess = (x * (scaled * p * (1 - p))[:, None]).T @ x + (0.05 + 1e-6) * np.eye(len(weights))
        weights = weights + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return Model(tuple(prior), table, weights)


def _worth(text: Column) -> Column:
    """The text if it can hold a span, else null: others need not go to Python."""
    return F.when(holds(text), text)


def holds(text: Column) -> Column:
    return text.rlike("[0-9@]") | text.rlike(NAMED)


def learn(docs: DataFrame) -> Model | None:
    """The model from the candidates of all texts; what comes to the driver is a row for each pattern of votes and features.

    Null and empty texts have none; repeated rows count each time; without any candidate, as for an empty table, there is no model (None), and
    only the fixed patterns are spans. Other columns are not looked at.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            for text in batch["text"]:
                for c in candidates(text):
                    key = (KINDS.index(c.kind), sum(v * 3**k for k, v in enumerate(c.votes)), c.features)
                    seen[key] = seen.get(key, 0) + 1
        if seen:
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", "votes", "features", "n"])

    texts = docs.select(_worth(F.col("text")).alias("text")).where("text is not null")
    patterns = texts.mapInPandas(count, "kind int, votes int, features int, n long").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect()
    return fit(sorted((KINDS[r["kind"]], tuple(r["votes"] // 3**k % 3 for k in range(len(LABELERS))), r["features"], r["n"]) for r in patterns))


def find(text: str, model: Model | None, memo: dict) -> list[dict]:
    out = []
    for c in candidates(text):
        if not c.base:
            if model is None:
                continue
            key = (c.kind, c.votes, c.features)
            if key not in memo:
                memo[key] = model.chance(*key) >= 0.5
            if not memo[key]:
                continue
        out.append({"kind": c.kind, "start": c.start, "end": c.end, "base": c.base})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def spans(text: Column, model: Model | None) -> Column:
    """All spans of a text (null or empty: none) by start, then kind, then end; offsets count code points, the end is exclusive.

    Spans of different kinds may overlap. A candidate whose chance is exactly one half is a span. Texts may be of any length; a
    row depends on its own text and the model alone.
    """

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        memo: dict = {}
        return pd.Series([find(t, model, memo) if t else [] for t in texts])

    return run(_worth(text))


def redact(text: Column, model: Model | None) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap are replaced as one, by the first one's kind."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        memo: dict = {}
        return pd.Series([_redacted(t, find(t, model, memo)) if t else t for t in texts])

    return F.when(holds(text), run(_worth(text))).otherwise(text)


def _redacted(text: str, found: list[dict]) -> str:
    out, at = [], 0
    for s in found:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]
