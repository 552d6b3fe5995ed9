"""Secrets in text: a keyword automaton, anchored patterns at its hits, then checksums inside the tokens."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds, key words and patterns.
KINDS = ("assign", "access", "hex", "github", "jwt", "private_key", "slack", "stripe", "google")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ADDED = {
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")),
    "jwt": (("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{10,}")),
    "private_key": (("-----begin",), re.compile(r"-----BEGIN (?:[A-Z]{2,12} )?PRIVATE KEY-----")),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxs-"), re.compile(r"xox[bpas]-[0-9A-Za-z]{8,}(?:-[0-9A-Za-z]{8,})+")),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{20,}")),
    "google": (("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])")),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18

_LOWER = {c: c + 32 for c in range(65, 91)}


def github_checksum(token: str) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    value, digits = zlib.crc32(token[4:34].encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == token[34:]


def jwt_header(token: str) -> bool:
    """The first part decodes to a JSON object that names its algorithm."""
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


CHECKS = {"github": github_checksum, "jwt": jwt_header}


def automaton():
    """Key words of all kinds but ``hex``, lower-cased."""
    import ahocorasick

    found = ahocorasick.Automaton()
    words: dict[str, list[str]] = {w: ["assign"] for w in ASSIGN_WORDS}
    words.setdefault("akia", []).append("access")
    for kind, (keys, _) in ADDED.items():
        for key in keys:
            words.setdefault(key, []).append(kind)
    for word, kinds in words.items():
        found.add_word(word, (len(word), tuple(kinds)))
    found.make_automaton()
    return found


def scan_text(text: str, found) -> list[tuple[int, int, int]]:
    """Spans (start, end, number of kind), sorted.

    Patterns are tried only where a key word begins, from left to right and for each kind apart; a match that fails its
    condition is consumed like any other, so the spans are those of a leftmost scan of the whole text.
    """
    spans: list[tuple[int, int, int]] = []
    lower = text.lower()
    if len(lower) != len(text):  # some capitals grow when lower-cased; places must stay
        lower = text.translate(_LOWER)
    hits: dict[str, list[int]] = {}
    for last, (length, kinds) in found.iter(lower):
        for kind in kinds:
            hits.setdefault(kind, []).append(last - length + 1)
    for kind, starts in hits.items():
        number, done = KINDS.index(kind), 0
        pattern = ASSIGN if kind == "assign" else ACCESS if kind == "access" else ADDED[kind][1]
        for start in sorted(starts):
            if start < done or not (m := pattern.match(text, start)):
                continue
            done = m.end()
            if kind == "assign" and len(m[2]) < LEAST_ASSIGNED or kind == "access" and done - start < LEAST_ACCESS:
                continue
            if kind not in CHECKS or CHECKS[kind](m[0]):
                spans.append((start, done, number))
    number = KINDS.index("hex")
    spans += [(m.start(), m.end(), number) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = automaton()
    for batch in batches:
        spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan_text(t, found)]
                 for t in batch["_text"].tolist()]
        yield pd.DataFrame({"_id": batch["_id"], "spans": spans})


SPANS = "array<struct<kind:string,start:long,end:long>>"


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, spans`` of (kind, start, end) by start, then kind.

    One pass without a shuffle.  Kinds beyond the first three are tokens of known form; GitHub tokens must
    carry their CRC-32 and JSON web tokens a header that decodes.  Null and empty texts have no spans;
    null and repeated ids are kept as they come; whole texts are scanned, in linear time.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.select(F.col(id_col).cast("string").alias("_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = sent.mapInPandas(_scan, f"_id string, spans {SPANS}")
    return out.select(F.col("_id").cast(id_type).alias(id_col), "spans")


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Texts with every span replaced by ``mark``; overlapping spans become one."""
    cut = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done")),
        lambda s, x: F.when(x["start"] < s["done"], F.struct(s["out"].alias("out"), F.greatest(s["done"], x["end"]).alias("done")))
        .otherwise(F.struct(
            F.concat(s["out"], F.substring(F.col(text_col), (s["done"] + 1).cast("int"), (x["start"] - s["done"]).cast("int")), F.lit(mark)).alias("out"),
            x["end"].alias("done"))),
        lambda s: F.concat(s["out"], F.substring(F.col(text_col), (s["done"] + 1).cast("int"), F.length(text_col))))
    return docs.join(found.select(id_col, "spans"), id_col, "left").withColumn(
        text_col, F.when(F.size("spans") > 0, cut).otherwise(F.col(text_col))).drop("spans")
