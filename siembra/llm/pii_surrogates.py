"""Keyed surrogates for personal data.

Detected entities are replaced by others of the same type, made from a keyed hash of the entity:
the same entity gets the same surrogate in every document (coreference), and shape is kept:
digits stay digits, letters keep their case and script, separators stay, cards keep their check
digit's validity and IBANs their country and valid check digits, addresses keep their top-level domain and share a surrogate domain exactly if they shared a domain,
names keep gender and script and are replaced part by part.

Distinctness is checked over the corpus: the distinct entities (combined before the shuffle) are
grouped by their surrogate; of those that share one, and of those whose surrogate is itself an
entity of the corpus, all but the first try again with the next attempt number until none is
left. Only entities with an attempt above 0 have to be told to the documents, by a join on the
text's hash; usually there are few or none.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.llm.shared import bit_filter, bound_batches, chunks, discard, materialise, may_hold, text_of

#: After so many attempts a surrogate may be longer than the entity.
WIDEN = 4
#: Rounds of collision checks at most; each round leaves a shrinking rest.
ROUNDS = 40

# Titles that name a gender, and given names by gender and script.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Господин": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Doña": "f", "Госпожа": "f", "Dr": "n", "Prof": "n"}
GIVEN = {
    "m": (
        "James John Robert Michael William David Richard Thomas Daniel Paul Peter Charles Joseph Mark George Steven Andrew Kevin Brian Edward Matthew Anthony Henry Jack Oliver "
        "Hans Klaus Jürgen Wolfgang Stefan Andreas Markus Uwe Dieter Pierre Jacques François Antoine Louis Luc Philippe Mathieu José Juan Carlos Miguel Luis Pedro Javier Diego Jorge Fernando "
        "Giovanni Marco Luca Paolo João Paulo Akira Hiroshi Kenji Takashi Raj Rahul Amit Arjun Vikram Ahmed Mohammed Omar Ali Hassan Wei Jun Min Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил Владимир"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Nancy Emma Jane Anna Alice Laura Julia Emily Olivia Sophia Margaret Helen Ruth Amy Rachel Lisa Kate "
        "Ursula Monika Petra Sabine Heike Ingrid Greta Marie Isabelle Camille Élodie Chloé Amélie Sophie María Carmen Josefa Lucía Isabel Ana Pilar Elena Rosa Teresa "
        "Giulia Chiara Francesca Paola Yuki Sakura Naoko Keiko Priya Anjali Lakshmi Sunita Fatima Aisha Leila Mei Ling Ольга Мария Елена Наталья Татьяна Светлана Анна Ирина Екатерина"
    ).split(),
}
_GENDER = {name: g for g, names in GIVEN.items() for name in names}
_NUMBER = re.compile(r"(?<![\w.+])(?:\+ ?)?\(?\d(?:[ .()\-]{0,2}\d){6,}(?![\w]|[.\-]\d)")
# Numbers that stand beside others in one run: each type by itself, the surest first; True asks for the check digit.
_CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7})(?!\d)")
_SSN = re.compile(r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)")
_PHONE = re.compile(r"(?:\+ ?\d{1,3}[ .\-]?|(?<!\d)1[ .\-])?(?:\(\d{3}\) ?|(?<!\d)\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)")
_PARTS = ((_SSN, "ssn", False), (_CARD, "card", True), (_PHONE, "phone", False), (_CARD, "card", False))
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9\-])")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9_\-/+]{12,})")
_KEY = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b")
_WORD = r"(?=\w[\w'’\-])[^\W\d_]+(?:['’\-](?!s\b)[^\W\d_]+)*"
_JOINS = re.compile(r"(['’\-])")
_TITLED = re.compile(r"\b(" + "|".join(sorted(TITLES, key=len, reverse=True)) + rf")\.? ({_WORD})(?: ({_WORD}))?")
_NAMED = re.compile(r"\b(" + "|".join(sorted(_GENDER, key=len, reverse=True)) + rf") ({_WORD})")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{2,39}(?![\w:])")
_IP = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")


class Entity(NamedTuple):
    """A span of a text with its kind and canonical form (what coreference goes by)."""

    start: int
    end: int
    kind: str
    canon: str


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(iban: str) -> bool:
    """Whether the check digits of an IBAN without spaces hold."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _is_ipv6(text: str) -> bool:
    if text.count(":") < 2:
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return any(c.isalnum() for c in text)


def _number(text: str) -> str | None:
    """Kind of a run of digits and separators."""
    if _IP.fullmatch(text):
        return "ip" if all(int(x) < 256 for x in text.split(".")) else None
    digits = "".join(c for c in text if c.isdigit())
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", text):
        return "ssn"
    if 13 <= len(digits) <= 19 and re.fullmatch(r"\d+|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}", text):
        return "card"
    if 9 <= len(digits) <= 15 and (text[0] in "+(" or re.search(r"\d[ .\-]\d{3}[ .\-]\d", text)):
        return "phone"
    return None


def _numbers(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of the numbers in a run of digits and separators: the whole run, else its parts."""
    if kind := _number(text[start:end]):
        yield start, end, kind
        return
    rest = [(start, end)]
    for pattern, kind, checked in _PARTS:
        left = []
        for a, b in rest:
            at = look = a
            while m := pattern.search(text, look, b):
                if checked and not luhn("".join(c for c in m[0] if c.isdigit())):
                    look = m.start() + 4 if m[1] else m.end()  # the next group of digits
                    continue
                yield m.start(), m.end(), kind
                left.append((at, m.start()))
                at = look = m.end()
            left.append((at, b))
        if left == rest:
            continue
        rest = []
        for a, b in left:  # what is left beside a number may be a whole one
            while a < b and text[a] in " .-)":
                a += 1
            while a < b and text[b - 1] in " .-(":
                b -= 1
            if a < b and (whole := _number(text[a:b])):
                yield a, b, whole
            elif a < b:
                rest.append((a, b))


def _script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "latin"


def detect(text: str) -> list[Entity]:
    """Entities of a text in order; of overlapping ones the first, then the longest."""
    found: list[Entity] = []
    for m in _IBAN.finditer(text):
        canon = m[0].replace(" ", "")
        if 15 <= len(canon) <= 34 and iban_valid(canon):
            found.append(Entity(m.start(), m.end(), "iban", canon))
    if text.count(":") > 1:
        found += [Entity(m.start(), m.end(), "ipv6", m[0].lower()) for m in _IPV6.finditer(text) if _is_ipv6(m[0])]
    for m in _NUMBER.finditer(text):
        for a, b, kind in _numbers(text, m.start(), m.end()):
            canon = text[a:b] if kind == "ip" else "".join(c for c in text[a:b] if c.isdigit())
            found.append(Entity(a, b, kind, canon))
    if "." in text:
        found += [Entity(m.start(), m.end(), "ip", m[0]) for m in re.finditer(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)", text) if all(int(x) < 256 for x in m[0].split("."))]
    if "@" in text:
        found += [Entity(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [Entity(m.start(1), m.end(1), "secret", m[1]) for m in _SECRET.finditer(text)]
    if "AKIA" in text or "ghp_" in text or "sk-" in text:
        found += [Entity(m.start(), m.end(), "secret", m[0]) for m in _KEY.finditer(text)]
    for pattern, titled in ((_TITLED, True), (_NAMED, False)):
        for m in pattern.finditer(text):
            gender = TITLES[m[1]] if titled else _GENDER[m[1]]
            words = [(g, m[g]) for g in ((2, 3) if titled else (1, 2)) if m[g] and m[g][0].isupper() and not m[g].isupper()]
            if len(words) < (1 if titled else 2) or words[0][0] != (2 if titled else 1):
                continue
            for g, word in words:
                given = word in _GENDER
                role = f"given:{_GENDER[word]}" if given else f"surname:{gender if _script(word) == 'cyrillic' else 'n'}"
                found.append(Entity(m.start(g), m.end(g), f"name:{role}:{_script(word)}", word))
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (e.start, -e.end, e.kind)):
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def _stream(key: bytes, kind: str, canon: str, attempt: int) -> Iterator[int]:
    """Bytes of a keyed hash, as long as wanted."""
    block = 0
    while True:
        yield from hashlib.blake2b(f"{kind}\0{canon}\0{attempt}\0{block}".encode(), key=key, digest_size=64).digest()
        block += 1


def _below(stream: Iterator[int], n: int) -> int:
    """A number below n, n at most 2^16, without bias that matters."""
    return ((next(stream) << 24) | (next(stream) << 16) | (next(stream) << 8) | next(stream)) % n


_ONSETS = {"latin": "b d f g h k l m n p r s t v br kr st tr".split(), "cyrillic": "б в г д ж з к л м н п р с т".split()}
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}
_ENDINGS = {("given:m", "latin"): ["n", "r", "s"], ("given:f", "latin"): ["a"], ("surname:n", "latin"): ["n", "r", "ck", "s"], ("given:m", "cyrillic"): ["н", "р"], ("given:f", "cyrillic"): ["на", "ла"], ("surname:m", "cyrillic"): ["ов", "ин"], ("surname:f", "cyrillic"): ["ова", "ина"], ("surname:n", "cyrillic"): ["енко"]}


def _name(kind: str, canon: str, stream: Iterator[int], attempt: int) -> str:
    """A name of the same role, gender and script; parts that a hyphen or apostrophe joins are replaced one by one."""
    _, role, gender, script = kind.split(":")

    def part(word: str) -> str:
        if len(word) == 1:  # a joint, or the O of O'Brien
            return word if not word.isalpha() else _ONSETS[script][_below(stream, 12)].upper()
        out = ""
        for _ in range(3 + attempt // WIDEN):
            out += _ONSETS[script][_below(stream, len(_ONSETS[script]))] + _VOWELS[script][_below(stream, 5)]
        endings = _ENDINGS[(f"{role}:{gender}", script)]
        ending = endings[_below(stream, len(endings))]
        if ending[0] in _VOWELS[script]:
            out = out[:-1]
        return (out + ending).capitalize()

    return "".join(part(x) for x in _JOINS.split(canon) if x)


def _alike(text: str, stream: Iterator[int], hexadecimal: bool = False) -> str:
    """Other characters of the same classes at the same places."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(_below(stream, 10)))
        elif "a" <= c.lower() <= "z":
            x = "abcdef"[_below(stream, 6)] if hexadecimal else chr(97 + _below(stream, 26))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical surrogate of an entity; never the entity itself."""
    for again in range(16):
        stream = _stream(key, kind, canon, attempt * 16 + again)
        if kind == "ip":
            out = ".".join(str(1 + _below(stream, 223)) if k == 0 else str(_below(stream, 256)) for k in range(4))
        elif kind == "email":
            # the domain is an entity of its own: domains map one to one, so local parts have to differ by domain only
            local, _, domain = canon.rpartition("@")
            out = _alike(local, stream) + "".join(chr(97 + _below(stream, 26)) for _ in range(2 * (attempt // WIDEN))) + "@" + domain
        elif kind == "domain":
            labels = canon.split(".")
            labels[:-1] = [_alike(x, stream) for x in labels[:-1]]
            labels[-2] += "".join(chr(97 + _below(stream, 26)) for _ in range(attempt // WIDEN))
            out = ".".join(labels)
        elif kind == "iban":
            rest = _alike(canon[4:], stream)
            out = next(x for k in range(2, 99) if iban_valid(x := f"{canon[:2]}{k:02d}{rest}"))
        elif kind == "ipv6":
            out = _alike(canon, stream, True)
        elif kind == "card":
            body = canon[0] + _alike(canon[1:-1], stream)
            valid = next(c for c in "0123456789" if luhn(body + c))
            out = body + (valid if luhn(canon) else str((int(valid) + 1 + _below(stream, 9)) % 10))
        elif kind == "phone":
            keep = max(0, len(canon) - 10)  # the country's digits
            out = canon[:keep] + _alike(canon[keep:], stream)
        elif kind == "ssn":
            out = _alike(canon, stream)
        elif kind == "secret":
            out = _alike(canon, stream, bool(re.fullmatch(r"[0-9a-fA-F]+", canon))) + "".join(str(_below(stream, 10)) for _ in range(attempt // WIDEN))
        else:
            out = _name(kind, canon, stream, attempt)
        if out != canon:
            return out
    return out


def shaped(entity: str, kind: str, out: str) -> str:
    """A canonical surrogate with the separators and the case of the entity as it stands in the text."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(out)
        return "".join(next(digits) if c.isdigit() else c for c in entity)
    if kind == "iban":
        signs = iter(out)
        return "".join(next(signs) if c != " " else c for c in entity)
    if kind in ("email", "ipv6"):
        return out.upper() if entity.isupper() else out
    return out


def replace(text: str, entities: list[Entity], key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[dict]]:
    """The text with surrogates, and where they stand in it."""
    parts, spans, at, size = [], [], 0, 0
    for e in entities:
        made = surrogate(key, e.kind, e.canon, attempts.get((e.kind, e.canon), 0))
        if e.kind == "email":
            local, _, domain = made.rpartition("@")
            made = f"{local}@{surrogate(key, 'domain', domain, attempts.get(('domain', domain), 0))}"
        new = shaped(text[e.start : e.end], e.kind, made)
        parts += [text[at : e.start], new]
        size += e.start - at
        spans.append({"kind": e.kind, "start": size, "end": size + len(new)})
        size += len(new)
        at = e.end
    return "".join([*parts, text[at:]]), spans


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt) of the distinct entities that can't have their first surrogate."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            made = pa.array([surrogate(key, r["kind"], r["canon"], r["attempt"]) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("canon"), b.column("attempt"), made], names=["kind", "canon", "attempt", "made"])

    shape = "kind string, canon string, attempt int, made string"
    settled = materialise(entities.withColumn("attempt", F.lit(0)).mapInArrow(name, shape), "surrogates")
    known = entities.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
    for _ in range(ROUNDS):
        # who may keep a surrogate: nobody if it is an entity, else the one that has had it for longer, then the first
        owner = settled.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n"))
        real = owner.join(known, (F.col("kind") == F.col("k")) & (F.col("made") == F.col("c")), "left").select(F.col("kind").alias("o_kind"), F.col("made").alias("o_made"), "first", (F.col("c").isNotNull()).alias("real"), "n").where("real or n > 1")
        real = materialise(real, "surrogate-clashes")
        if real.isEmpty():
            break
        judged = settled.join(real, (F.col("kind") == F.col("o_kind")) & (F.col("made") == F.col("o_made")), "left")
        loses = F.col("o_made").isNotNull() & (F.col("real") | (F.col("first.canon") != F.col("canon")))
        again = judged.where(loses).select("kind", "canon", (F.col("attempt") + 1).alias("attempt")).mapInArrow(name, shape)
        before, settled = settled, materialise(judged.where(~loses).select("kind", "canon", "attempt", "made").unionByName(again), "surrogates")
        discard(before, real)
    else:
        raise RuntimeError(f"surrogates still clash after {ROUNDS} rounds")
    later = materialise(settled.where("attempt > 0").select("kind", "canon", "attempt"), "surrogates-later")
    discard(settled, real)
    return later


def _wanted(found: list[Entity]) -> Iterator[tuple[str, str]]:
    """Kind and canonical form of what needs a surrogate: the entities, and the domains of addresses."""
    for e in found:
        yield e.kind, e.canon
        if e.kind == "email":
            yield "domain", e.canon.rpartition("@")[2]


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts with surrogates: the id, ``text``, ``n_entities`` and ``entities`` (kind, start, end in the new text).

    One row per input row. Null and empty texts stay empty and have no entities; texts without
    entities are unchanged. The key is text of 1 to 64 bytes; another key gives other surrogates.
    Repeated rows are treated alike; an empty table gives an empty result. Other columns aren't read.
    Names are found by a title or by a given name of ``GIVEN``, two capitalised words; others stay.
    """
    bound_batches(df.sparkSession)
    secret = key.encode()
    base = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in chunks(batches):
            rows = {(h, *x) for h, t in zip(part.column("hash").to_pylist(), part.column("text").to_pylist(), strict=True) for x in _wanted(detect(t))}
            yield pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate((("hash", pa.int64()), ("kind", pa.string()), ("canon", pa.string())))})

    met = materialise(base.select("hash", "text").mapInArrow(find, "hash long, kind string, canon string"), "entities")
    later = assign(met.select("kind", "canon").distinct(), secret)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_entities", T.IntegerType()), T.StructField("entities", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)
    # texts that hold an entity, and those that hold one with a later attempt: only these are searched again, and only the latter are shuffled
    by_text = materialise(met.join(later, ["kind", "canon"]).groupBy("hash").agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias("later")), "surrogates-by-text")
    holds = materialise(met.select("hash").distinct(), "entity-texts")
    discard(met, later)
    marked = base.withColumn("holds", may_hold(bit_filter(holds, "hash"), F.col("hash")))
    told = may_hold(bit_filter(by_text.select("hash"), "hash"), F.col("hash"))
    plain = marked.where(~told).select("id", "text", "holds", F.lit(None).cast(by_text.schema["later"].dataType).alias("later"))
    joined = marked.where(told).join(by_text, "hash", "left").select("id", "text", "holds", "later")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in chunks(batches):
            texts, spans = [], []
            for text, some, more in zip(part.column("text").to_pylist(), part.column("holds").to_pylist(), part.column("later").to_pylist(), strict=True):
                new, where = replace(text, detect(text), secret, {(x["kind"], x["canon"]): x["attempt"] for x in more or ()}) if some else (text, [])
                texts.append(new)
                spans.append(where)
            columns = [part.column("id"), pa.array(texts, pa.string()), pa.array([len(x) for x in spans], pa.int32()), pa.array(spans, shape.field("entities").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return plain.unionByName(joined).mapInArrow(put, schema)
