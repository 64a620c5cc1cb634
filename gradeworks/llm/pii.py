"""Personal data: base patterns, and weak candidates that labelers, a label model and a span classifier decide."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import cut, packed
from gradeworks.llm.label_model import fit, patterns

BASE = ("email", "ip", "card", "phone")
WEAK = ("email_spoken", "phone_local", "national_id", "iban", "name", "street", "birth_date")
KINDS = BASE + WEAK
LABELERS = ("l_form", "l_cue", "l_gazetteer", "l_place", "l_digits", "l_sum")
#: A weak span needs the support of one of these at least; surroundings alone are no evidence.
EVIDENCE = ("l_cue", "l_gazetteer", "l_sum")

# The patterns of the contract (an address is found by its domain, see _emails).
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DIGIT = re.compile("[0-9]")

SPOKEN = re.compile(r"\b[A-Za-z0-9._-]{2,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{2,63} ?[(\[]dot[)\]] ?[A-Za-z]{2,10}\b", re.ASCII)
NATIONAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
PHONE_LOCAL = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z-])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])")
# Gazetteers: given names, titles, and kinds of streets.
GIVEN = frozenset(
    """adam alan alice amelia amy ana andrea andrew anna anne antonio barbara benjamin brian carla carlos carmen
    carol caroline charles charlotte chloe christian christine claire daniel david diana elena elizabeth emily emma
    eric erik eva felix florian francisco frank franziska george grace hannah hans heinrich helen henry ines isabel
    ivan jack jacob james jan jane javier jean jennifer jessica joan john jonas jose joseph juan judith julia julien
    karen karl katharina kevin klaus laura lea leon linda lisa louis louise lucas lucia luis luke manuel marc marco
    margaret maria marie mario mark martin mary matthew max michael miguel monika nicolas nina nora olga oliver
    oscar patricia patrick paul paula pedro peter petra philip pierre rachel richard robert rosa ruth samuel sandra
    sara sarah sebastian simon sofia sophie stefan stephen susan teresa thomas tim tom ursula victor walter william""".split()
)
TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Sr|Sra|Don|Doña)\.?"
NAME = re.compile(rf"\b(?:({TITLE}) )?([A-Z][a-zà-ÿ]+)(?: [A-Z]\.)? [A-Z][a-zà-ÿ]+(?:-[A-Z][a-zà-ÿ]+)?\b")
STREET = re.compile(
    r"\b[0-9]{1,5} (?:[A-Z][a-zà-ÿ]+ ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Square|Boulevard)\b"
    r"|\b[A-Z][a-zà-ÿ]+(?:straße|strasse|gasse|weg|platz|allee) [0-9]{1,4}[a-z]?\b"
    r"|\b[0-9]{1,4},? (?:rue|avenue|boulevard|place) (?:de |du |des |la |le )*[A-Z][a-zà-ÿ]+\b"
    r"|\b(?:Calle|Avenida|Plaza) (?:de |del |la |los )*[A-Z][a-zà-ÿ]+,? [0-9]{1,4}\b"
)
BIRTH = re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/-])")
# Words that announce personal data, and those that announce other numbers and names.
CUES = re.compile(r"\b(?:name|named|signed|patient|customer|dear|address|lives at|resides|born|birth|dob|geboren|adresse|anschrift|né le|née le|dirección|nacid[oa]|phone|tel|telephone|mobile|cell|call|fax|whatsapp|contact|e-?mail|mail|reach|ssn|social|iban|account|konto|telefon|téléphone|teléfono|correo|courriel)\b", re.I)
OTHERS = re.compile(r"\b(?:version|order|invoice|isbn|page|figure|table|chapter|section|lot|part|item|id|serial|build|year|company|founded|published|released|university|museum)\b", re.I)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(t: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, each found from its @ so that a long run of letters is read once."""
    out, last = [], 0
    for m in DOMAIN.finditer(t):
        i = m.start()
        while i > last and LOCAL.match(t[i - 1]):
            i -= 1
        if i < m.start():
            out.append((i, m.end()))
            last = m.end()
    return out


def base_spans(t: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in _emails(t)] if "@" in t else []
    if DIGIT.search(t):
        out += [("ip", *m.span()) for m in IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in t:
            out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(_digits(m[0])) <= 15]
    return out


def weak_spans(t: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates outside of the base spans."""
    out = [("email_spoken", *m.span()) for m in SPOKEN.finditer(t)] if "at" in t and "dot" in t and ("(" in t or "[" in t) else []
    if DIGIT.search(t):
        out += [("national_id", *m.span()) for m in NATIONAL.finditer(t)]
        out += [("phone_local", *m.span()) for m in PHONE_LOCAL.finditer(t) if 9 <= len(_digits(m[0])) <= 13]
        out += [("iban", *m.span()) for m in IBAN.finditer(t)]
        out += [("street", *m.span()) for m in STREET.finditer(t)]
        out += [("birth_date", *m.span()) for m in BIRTH.finditer(t)]
    out += [("name", *m.span()) for m in NAME.finditer(t) if m[1] or m[2].lower() in GIVEN]
    if out and base:
        start = np.sort([b for _, b, _ in base])
        end = np.sort([e for _, _, e in base])
        out = [x for x in out if np.searchsorted(start, x[2]) == np.searchsorted(end, x[1], side="right")]
    return out


def label(t: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Votes of LABELERS on a span: 1 personal, -1 not, 0 no opinion."""
    s, before = t[start:end], t[max(0, start - 40) : start]
    d = _digits(s)
    cue, other = bool(CUES.search(before)), bool(OTHERS.search(before))
    around = t[max(0, start - 1) : start] + t[end : end + 1]
    place = -1 if re.search(r"[A-Za-z0-9_/=]", around) else 1 if before.rstrip(" ")[-1:] in (":", "(", "<") else 0
    if kind == "iban":
        whole = "".join(str(int(c, 36)) for c in s[4:] + s[:4])
        check = 1 if int(whole) % 97 == 1 else -1
    elif kind == "card":
        check = 1
    elif kind in ("phone", "phone_local"):
        check = 0 if 10 <= len(d) <= 12 else -1
    elif kind == "birth_date":
        parts = sorted(int(x) for x in re.split("[./-]", s))
        check = 0 if parts[0] and parts[0] <= 12 and parts[1] and parts[1] <= 31 else -1
    elif kind == "national_id":
        check = -1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 0
    else:
        check = 0
    known = kind == "street" or kind == "name" and any(x.lower() in GIVEN for x in re.findall("[A-Za-zà-ÿ]+", s))
    return (int(kind in BASE), 1 if cue and not other else -1 if other and not cue else 0, int(known), place, 0 if not d else -1 if len(set(d)) < 3 else 0, check)


SCAN = "doc_id long, base array<struct<kind:string,start:long,end:long>>, weak array<struct<kind:string,start:long,end:long,votes:array<int>>>, votes array<string>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text, and the votes on every one of them as text: kind and votes."""
    span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    for batch in batches:
        base, weak, votes = [], [], []
        for t in batch.column(1):
            t = t.as_py() or ""
            b = base_spans(t)
            w = weak_spans(t, b)
            base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in b])
            weak.append([{"kind": k, "start": i, "end": j, "votes": label(t, k, i, j)} for k, i, j in w])
            votes.append([" ".join(map(str, (x[0], *label(t, *x)))) for x in b] + [" ".join(map(str, (x["kind"], *x["votes"]))) for x in weak[-1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(pa.struct(span))), pa.array(weak, pa.list_(pa.struct([*span, ("votes", pa.list_(pa.int32()))]))), pa.array(votes, pa.list_(pa.string()))], ["doc_id", "base", "weak", "votes"])


def _features(kind: str, votes: tuple[int, ...]) -> np.ndarray:
    return np.array([1.0, *(float(kind == k) for k in WEAK), *(float(v > 0) for v in votes[1:]), *(float(v < 0) for v in votes[1:])])


def train(scanned: DataFrame, steps: int = 300) -> np.ndarray:
    """Weights of the span classifier, from the votes of all spans.

    The label model's reliabilities are found over the vote table; the classifier is a logistic regression
    of its posteriors on kind and votes without the pattern labeler, so that it can tell weak spans apart.
    The driver sees one row per kind and combination of votes: at most 11 * 3^6, however many spans there are.
    """
    parts = F.split("v", " ")
    rows = scanned.select(F.explode("votes").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    table = cut(rows.select("n", parts[0].alias("kind"), *[parts[i + 1].cast("int").alias(r) for i, r in enumerate(LABELERS)]))
    counts = table.groupBy(*LABELERS).agg(F.sum("n").alias("n"))
    model = fit(counts, LABELERS, prior=0.5)
    seen = table.collect()
    if not seen:
        return np.zeros(len(_features("", (0,) * len(LABELERS))))
    x = np.array([_features(r.kind, tuple(r[k] for k in LABELERS)) for r in seen])
    weight = np.array([r.n for r in seen], float)
    score = np.array([model["prior"] + sum(model["rules"][k][0] if r[k] > 0 else model["rules"][k][1] if r[k] < 0 else 0.0 for k in LABELERS) for r in seen])
    y, w = 1 / (1 + np.exp(-score)), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - 0.01 * w)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def accepted(weak: list, weights: np.ndarray, least: float = 0.5) -> list[tuple[str, int, int]]:
    """The weak spans that have evidence and that the classifier takes."""
    some = [(k, i, j, v) for k, i, j, v in weak if any(v[LABELERS.index(e)] > 0 for e in EVIDENCE)]
    return [(k, i, j) for k, i, j, v in some if 1 / (1 + np.exp(-_features(k, tuple(v)) @ weights)) >= least]


def _ordered(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def personal(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, code points).

    Null texts count as empty: no spans. Rows are judged by their text alone; null ids are carried
    through. Empty table: no rows.
    """
    scanned = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, SCAN))
    weights = train(scanned)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                base = [(x["kind"], x["start"], x["end"]) for x in b]
                more = accepted([(x["kind"], x["start"], x["end"], x["votes"]) for x in w], weights)
                out.append([*(sum(k == x[0] for x in base) for k in BASE), hashlib.sha256(_ordered(base).encode()).hexdigest(), _ordered(base + more)])
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return scanned.select("doc_id", "base", "weak").mapInArrow(digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(t: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each group of overlapping spans replaced by its first kind in brackets."""
    out, at = [], 0
    for k, i, j in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if i >= at:
            out += [t[at:i], f"[{k.upper()}]"]
        at = max(at, j)
    return "".join(out) + t[at:]


def stage(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars`` (where there is one) counted anew; null texts stay null."""
    scanned = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, SCAN)
    weights = train(scanned.where("size(votes) > 0").select("votes"))

    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            out = []
            for t in part:
                t = t.as_py()
                if t:
                    base = base_spans(t)
                    weak = [(*x, label(t, *x)) for x in weak_spans(t, base)]
                    t = redact(t, base + accepted(weak, weights))
                out.append(t)
            yield pa.array(out, pa.string())

    masked = packed(docs).withColumn("text", F.arrow_udf(clean, "string")("text"))
    return masked.select(*[F.col("text") if c == "text" else F.when(F.col("text").isNotNull(), F.length("text")).cast(t).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c, t in docs.dtypes])
