"""Personal data by weak supervision.

Candidates are spans that look like personal data: valid emails, IPv4 addresses, payment cards and phone
numbers (the base, always kept) and weaker look-alikes: spelt-out addresses, grouped digits, long runs of letters and
digits.  Many look-alikes are none: order numbers, dates, digits without a checksum.  Six labelers (shape, checksum or
charset, gazetteer, context words, neighbouring characters, length) vote yes, no or abstain on each candidate, and
they disagree.  Votes of all candidates of the corpus are counted by pattern; expectation-maximisation over the counts
estimates, for every kind apart (drawn towards the estimate over all kinds where a kind is rare), how reliable each
labeler is; a logistic regression learns the resulting soft labels from the votes and the span's form and decides every
look-alike in the end.  Patterns are a bounded set (kinds x 3**labelers x forms), so both models are fitted on exact
counts over all rows, however many.

Defined cases: a null text counts as empty and has no spans; an empty table gives no rows; repeated rows get equal
results and count each; a chance of exactly one half is accepted; with no candidates anywhere only base rules remain;
extra columns are ignored; any length of text is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import let_go, text_slices

KINDS = ["email", "ip", "card", "phone"]
LOOSE_KINDS = ["contact", "number", "secret"]
ALL_KINDS = KINDS + LOOSE_KINDS
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = re.compile(
    r"(?P<contact>(?<![A-Za-z0-9])[A-Za-z0-9._-]{2,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,12}){1,3})"
    r"|(?P<number>(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,5}(?![0-9A-Za-z]))"
    r"|(?P<secret>(?<![A-Za-z0-9])(?:(?=[A-Za-z]{0,40}[0-9])[A-Za-z0-9]{16,128}|AKIA[A-Z0-9]{16})(?![A-Za-z0-9]))"
)
#: Word lists of the gazetteer and context labelers.
DOMAINS = {"com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu"}
YES = re.compile(r"(?i)e-?mail|contact|phone|tel|call|mobile|card|visa|account|iban|ssn|token|secret|passw|key|address|host|login|user")
NO = re.compile(r"(?i)version|isbn|issn|figure|table|chapter|section|page|order|license|commit|sha|rfc")
LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards, so that long words cost no more than short ones."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _RUN.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    out.sort()
    return out


def pattern(text: str, start: int, end: int, kind: int) -> int:
    """The votes (0 no, 1 abstain, 2 yes) of all labelers and the span's form, as one number."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 2]
    digits = "".join(c for c in span if "0" <= c <= "9")
    share, letters = len(digits) / max(1, len(span)), sum(c.isalpha() for c in span)
    name = ALL_KINDS[kind]
    yes_no = lambda yes, no: 2 if yes else 0 if no else 1
    if name == "number":
        groups = [len(g) for g in re.findall("[0-9]+", span)]
        shape = yes_no(groups == [3, 3, 4], len(digits) < 9 or groups[0] == 4 or groups == [2, 2, 4])
        check = yes_no(False, len(set(digits)) <= 2)
        known = yes_no(span.startswith("("), digits[:2] in ("19", "20") and len(digits) <= 8)
        beside = yes_no(before.endswith((": ", "= ", "tel ")), before.rstrip()[-1:].isdigit() or after.strip()[:1].isdigit())
        length = yes_no(len(digits) in (10, 11), len(digits) < 9)
    elif name == "secret":
        shape = yes_no(letters and digits and (span.isupper() or span.islower()), not letters)
        check = yes_no(len(set(span)) >= 10 and letters, luhn(digits) is False if not letters else len(set(span)) <= 5)
        known = yes_no(span.startswith(("AKIA", "ghp", "xox", "sk", "eyJ")), len(digits) <= 2 and letters > 20 and not span.isupper())
        beside = yes_no(before[-1:] in tuple("=:\"'") and before, before[-1:] in tuple("/.-#") or (not letters and before[-1:].isspace()))
        length = yes_no(len(span) in (18, 20, 32, 40, 64), len(span) > 100 or not letters)
    elif name == "contact":
        shape = yes_no("dot" in span or re.search(r"\.[A-Za-z]{2,4}$", span), " " in span.strip() and "(" not in span and "[" not in span)
        check = yes_no(False, len(span.split()) > 7)
        known = yes_no(re.split(r"[ .)\]]", span.rstrip())[-1].lower() in DOMAINS, True)
        beside = yes_no(before[-1:] in tuple(":<(") and before, False)
        length = yes_no(len(span) >= 9, len(span) < 9)
    else:
        shape = 2
        check = yes_no(name == "card" or (name == "email" and letters > 4), False)
        known = yes_no(span.rpartition(".")[2].lower() in DOMAINS, True) if name == "email" else yes_no(name == "phone" and span[1] in "1234", name == "ip" and span.startswith(("0.", "127.", "255.")))
        beside = yes_no(before[-1:] in tuple(":=<") and before, before[-1:] in tuple("v/") and before)
        length = yes_no(len(span) >= 7, False)
    context = yes_no(YES.search(before), NO.search(before))
    code = 0
    for v in (shape, check, known, context, beside, length):
        code = code * 3 + v
    form = min(3, len(span) // 10) * 2 + (share > 0.5)
    return (kind * 8 + form) * 3**LABELERS + code


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans, and weaker (start, kind, end, pattern) that overlap none of them."""
    base = base_spans(text)
    loose = []
    if "@" in text or _DIGIT.search(text) or "(at)" in text or "[at]" in text:
        taken = 0
        for m in _LOOSE.finditer(text):
            while taken < len(base) and base[taken][2] <= m.start():
                taken += 1
            if taken < len(base) and base[taken][0] < m.end():
                continue
            kind = 4 + LOOSE_KINDS.index(m.lastgroup)
            loose.append((m.start(), kind, m.end(), pattern(text, m.start(), m.end(), kind)))
    return base, loose


def _em(votes: np.ndarray, n: np.ndarray, pull: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Chances and vote shares by expectation-maximisation; `pull` (truth x labeler x vote) are counts drawn towards."""
    p = np.clip(0.5 + 0.12 * (votes - 1).sum(axis=1), 0.05, 0.95)  # the start: a majority vote
    given = np.full((2, LABELERS, 3), 1 / 3)
    for _ in range(rounds):
        for truth, share in ((1, p), (0, 1 - p)):
            for i in range(LABELERS):
                got = np.bincount(votes[:, i], n * share, 3) + pull[truth, i]
                got[1] = 0.0  # an abstention says nothing either way
                given[truth, i] = got / got.sum()
                given[truth, i, 1] = 1.0
        prior = np.clip((n @ p + 1) / (n.sum() + 2), 0.01, 0.99)
        odds = np.log(prior / (1 - prior)) + sum(np.log(given[1, i, votes[:, i]] / given[0, i, votes[:, i]]) for i in range(LABELERS))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, given


def reliabilities(counts: dict[int, int], rounds: int = 50, strength: float = 8.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns, the chance that each is personal data, and the vote shares given the truth (kind x truth x labeler x vote).

    Base kinds and look-alikes are estimated apart; each kind is drawn towards the estimate over its like by `strength` votes.
    """
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes.tolist()], float)
    votes = np.stack([codes % 3**LABELERS // 3 ** (LABELERS - 1 - i) % 3 for i in range(LABELERS)], axis=1)
    kinds = codes // 3**LABELERS // 8
    # before any vote is seen: labelers are right more often than not
    start = np.array([[[2.0, 0.0, 1.0]] * LABELERS, [[1.0, 0.0, 2.0]] * LABELERS])
    p, given = np.zeros(len(codes)), np.full((len(ALL_KINDS), 2, LABELERS, 3), 1 / 3)
    for like in (kinds < len(KINDS), kinds >= len(KINDS)):
        if like.any():
            pull = _em(votes[like], n[like], start, rounds)[1] * strength
            for kind in np.unique(kinds[like]).tolist():
                p[kinds == kind], given[kind] = _em(votes[kinds == kind], n[kinds == kind], pull, rounds)
    return codes, p, given


def span_classifier(counts: dict[int, int], steps: int = 400) -> dict[int, float]:
    """The chance of every pattern, from a logistic regression on votes, kind and form trained on the soft labels."""
    if not counts:
        return {}
    codes, p, _ = reliabilities(counts)
    n = np.array([counts[c] for c in codes.tolist()], float)
    x = np.concatenate([np.eye(3)[codes % 3**LABELERS // 3**i % 3] for i in range(LABELERS)] + [np.eye(len(ALL_KINDS) * 8)[codes // 3**LABELERS], np.ones((len(codes), 1))], axis=1)
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(steps):
        w -= 2.0 * (x.T @ (share * (1 / (1 + np.exp(-x @ w)) - p)) + 1e-4 * w)
    return dict(zip(codes.tolist(), (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


SPANS = "base array<struct<start:int,kind:int,end:int>>, loose array<struct<start:int,kind:int,end:int,pattern:int>>, base_patterns array<int>"


def scan(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, base spans, weaker candidates and the base spans' patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        of = lambda *names: pa.list_(pa.struct([(n, pa.int32()) for n in names]))
        for batch, texts in text_slices(batches):
            base, loose, codes = [], [], []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                b, more = candidates(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in b])
                loose.append([{"start": s, "kind": k, "end": e, "pattern": c} for s, k, e, c in more])
                codes.append([pattern(text, s, e, k) for s, k, e in b])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base, of("start", "kind", "end")), pa.array(loose, of("start", "kind", "end", "pattern")), pa.array(codes, pa.list_(pa.int32()))],
                names=["doc_id", "base", "loose", "base_patterns"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, {SPANS}")


def fit(scanned: DataFrame) -> dict[int, float]:
    """Pattern -> chance, from the votes on all candidates."""
    codes = scanned.select(F.explode(F.concat("base_patterns", F.transform("loose", lambda s: s["pattern"]))).alias("pattern"))
    return span_classifier({r["pattern"]: r["count"] for r in codes.groupBy("pattern").count().collect()})


def accepted(scanned: DataFrame, chances: dict[int, float], at_least: float = 0.5) -> DataFrame:
    """scanned with `spans`: base spans and the weaker ones the classifier accepts, in order of start, then kind."""
    good = [c for c, p in chances.items() if p >= at_least and c // 3**LABELERS // 8 >= len(KINDS)]
    kept = F.filter("loose", lambda s: s["pattern"].isin(good)) if good else F.filter("loose", lambda s: F.lit(False))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", F.transform(kept, plain))))


def redact(docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """docs with every accepted span of their texts replaced by its kind in square brackets; all rows and columns stay."""
    chances = fit(scan(docs))
    good = frozenset(c for c, p in chances.items() if p >= at_least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch, texts in text_slices(batches):
            out = []
            for raw, old in zip(texts, batch.column("text").is_valid().to_pylist(), strict=True):
                text = raw.decode("utf-8", "replace")
                base, loose = candidates(text)
                parts, done = [], 0
                for start, kind, end in sorted([*base, *((s, k, e) for s, k, e, c in loose if c in good)]):
                    if end <= done:
                        continue
                    if start >= done:
                        parts += [text[done:start], f"[{ALL_KINDS[kind].upper()}]"]
                    done = end
                out.append("".join([*parts, text[done:]]) if old else None)
            i = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*batch.columns[:i], pa.array(out, pa.string()), *batch.columns[i + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
