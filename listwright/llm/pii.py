"""Personal data replaced by surrogates (operator 9).

Found are e-mail addresses, IPv4 addresses, account numbers (IBAN with right check
digits), payment-card numbers, social-security numbers, phone numbers, and names: a
given name of the list below or a title before capitalised words of any script, and
wherever else in the text a surname found so stands alone. Other names are not
found. Every entity gets a surrogate that a secret key
determines, of the same type, format and script: digits stay digits at the same
places, country codes stay, octets stay octets, a card keeps its check-digit
state, an account its country and right check digits, a name its gender, script,
length class and capitals. Parts of
names are entities of their own, so "Anna Berg" and "Ms Berg" stay connected,
and one entity has one surrogate in the whole corpus however it is written.

Distinctness is checked over all documents: where two entities of a type share
a surrogate, or a surrogate is itself an entity of the corpus, all but the
smallest entity try the next surrogate, until no two meet. Names grow by a syllable
every few tries and numbers give up the digits they keep, so there is room for any
number of entities that a format can tell apart. Those that needed
more than the first try go to a table, which is joined to the documents that
hold them; all others are computed where they stand. Nothing is collected.

Defined cases: a null text stays null without entities; an empty text stays empty; rows that
share a doc_id are handled one by one; other columns are kept as they are; an
empty table gives an empty one.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.llm.common import materialize, query, table

ROUNDS = 100
GROW = 3  # tries after which a surrogate gets more room

# Given names by gender, in Latin, Cyrillic and Greek script.
FEMALE = (
    "Anna Maria Emma Laura Julia Sarah Sophie Marie Clara Elena Lucia Carmen Ana Isabel Claire Camille Alice Mary Linda "
    "Susan Karen Lisa Nancy Betty Sandra Ashley Emily Olivia Chloe Petra Monika Sabine Ingrid Heike Pilar Mercedes "
    "Jennifer Patricia Elizabeth Barbara Jessica Анна Мария Елена Ольга Μαρία Ελένη"
).split()
MALE = (
    "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Mark Paul Steven Andrew Peter Hans "
    "Klaus Wolfgang Stefan Jürgen Jean Pierre Jacques Michel Luc Carlos José Juan Luis Miguel Antonio Javier Pablo "
    "Joseph Christopher Anthony George Kenneth Kevin Иван Пётр Сергей Олег Γιώργος Νίκος"
).split()
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Monsieur": "m", "Madame": "f", "Mme": "f"}
GENDER = {x: "f" for x in FEMALE} | {x: "m" for x in MALE}

EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = re.compile(rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.[0-9])")
CARD = re.compile(r"(?<![\w+-])(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){1,2}(?:\1[0-9]{1,4})?)(?![\w-])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
PHONE = re.compile(
    r"(?<![\w+(.-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}"
    r"|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}[ /-][0-9]{3,8})(?![\w-])"
)
IBAN = re.compile(r"(?<![\w-])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])")
CAPITAL = rf"[{''.join(chr(k) for k in range(0x10000) if chr(k).isupper())}][^\W\d_]+(?:-[^\W\d_]+)?"
NAME = re.compile(
    rf"\b(?:(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?P<titled>{CAPITAL}(?: {CAPITAL})?)"
    rf"|(?P<given>{'|'.join(sorted(GENDER, key=len, reverse=True))}) (?P<last>{CAPITAL}))(?!\w)"
)
CAPITAL_WORD = re.compile(rf"\b{CAPITAL}(?!\w)")
# Capitalised words that are no surname behind a given name.
STOPS = frozenset(
    "The This That These Those There Then And Or But For Not With From Had Has Have Was Were Will Would Could Should Can May Must Did Does Said Says "
    "Is Are Who What When Where Why How His Her He She It They We You If As At In On Of To By So No Yes "
    "Der Die Das Und Oder Aber Hat Hatte War Ist Sind Nicht Mit Von Wer Was Wann Wie Er Sie Es Wir Ihr "
    "El La Los Las Y Pero Con Por Para Que Era Fue Es Son Le Les Et Ou Mais Avec Pour Dans Qui Est Il Elle Nous Vous "
    "Он Она Они Мы Вы Это Что Как Где Когда И Но Не".split()
)
NUMBERS = (("email", EMAIL), ("ip", IP), ("ssn", SSN), ("iban", IBAN), ("card", CARD), ("phone", PHONE))
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве".split(),
    "greek": "βα βε βο δα δε δο γα γο κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το".split(),
}
ENDINGS = {"latin": {"f": "na", "m": "ro", "n": "li"}, "cyrillic": {"f": "на", "m": "ров", "n": "ли"}, "greek": {"f": "να", "m": "ρος", "n": "λι"}}


Span = tuple[int, int, str, str]


def merged(taken: list[Span], new: list[Span]) -> list[Span]:
    """Both in order; what of ``new`` overlaps ``taken`` is left out. Both are in order and free of overlaps, so one walk does."""
    out, k = [], 0
    for x in new:
        while k < len(taken) and taken[k][1] <= x[0]:
            out.append(taken[k])
            k += 1
        if k == len(taken) or taken[k][0] >= x[1]:
            out.append(x)
    return out + taken[k:]


def right_iban(value: str) -> bool:
    return int("".join(str(int(x, 36)) for x in value[4:] + value[:4])) % 97 == 1


def names(text: str) -> Iterator[Span]:
    """Given names and surnames in order."""
    at = 0
    while m := NAME.search(text, at):
        at = m.end()
        words = (m["titled"] or m["last"]).split(" ")
        if words[-1] in STOPS:
            words.pop()
        if m["given"]:
            if not words:
                at = m.end("given")
                continue
            yield m.start("given"), m.end("given"), f"given_{GENDER[m['given']]}", m["given"].lower()
        start = m.start("titled") if m["titled"] else m.start("last")
        for k, word in enumerate(words):
            given = bool(m["titled"]) and k == 0 and len(words) == 2
            yield start, start + len(word), f"given_{GENDER.get(word) or TITLES[m['title']]}" if given else "surname", word.lower()
            start += len(word) + 1


def find(text: str | None) -> list[Span]:
    """``(start, end, type, canonical entity)`` in order, without overlaps; the first type of the list wins."""
    if not text:
        return []
    out: list[Span] = []
    if "@" in text or re.search("[0-9]", text):
        for kind, rule in NUMBERS:
            if kind == "email" and "@" not in text:
                continue
            new = []
            for m in rule.finditer(text):
                value = m.group()
                if kind in ("card", "ssn", "phone"):
                    value = re.sub("[^0-9]", "", value)
                    if kind == "phone" and not 7 <= len(value) <= 15:
                        continue
                if kind == "iban":
                    value = value.replace(" ", "")
                    if not right_iban(value):
                        continue
                new.append((m.start(), m.end(), kind, value.lower()))
            out = merged(out, new)
    people = list(names(text))
    out = merged(out, people)
    surnames = {x[3] for x in people if x[2] == "surname"}
    if surnames:
        again = [(m.start(), m.end(), "surname", m.group().lower()) for m in CAPITAL_WORD.finditer(text) if m.group().lower() in surnames]
        out = merged(out, again)
    return out


class Stream:
    """Numbers that the key, the type, the entity and the try determine."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.block, self.left = key, f"{kind}\0{entity}\0{attempt}".encode("utf-8", "replace"), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def luhn(digits: str) -> int:
    total = 0
    for k, x in enumerate(reversed(digits)):
        n = int(x) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= x <= "ӿ" for x in word) else "greek" if any("Ͱ" <= x <= "Ͽ" for x in word) else "latin"


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical entity."""
    draw = Stream(key, kind, entity, attempt).below
    if kind == "email":
        local, _, domain = entity.partition("@")
        host, _, top = domain.rpartition(".")
        change = lambda x: re.sub("[a-z0-9]", lambda m: chr(97 + draw(26)) if m.group().isalpha() else str(draw(10)), x)
        # The address keeps its pattern; very short ones get room for as many entities as there may be.
        return f"{change(local)}{''.join(chr(97 + draw(26)) for _ in range(max(0, 10 - len(local))))}@{change(host)}.{top}"
    if kind == "ip":
        return ".".join(str(draw(223) + 1) if k == 0 else str(draw(256)) for k in range(4))
    if kind in ("card", "ssn", "phone"):
        keep = max(0, (1 if kind != "phone" else min(len(entity) - 7, 3)) - attempt // GROW)
        digits = entity[:keep] + "".join(str(draw(10)) for _ in entity[keep:])
        if kind == "card":
            digits = next(d for x in range(10) if (luhn(d := digits[:-1] + str(x)) == 0) == (luhn(entity) == 0))
        return digits
    if kind == "iban":
        body = "".join(chr(97 + draw(26)) if x.isalpha() else str(draw(10)) for x in entity[4:])
        return entity[:2] + next(c for x in range(2, 99) if right_iban(entity[:2] + (c := f"{x:02d}") + body)) + body
    script, gender = script_of(entity), kind[-1] if kind.startswith("given") else "n"
    return "".join(SYLLABLES[script][draw(len(SYLLABLES[script]))] for _ in range(max(3, min(6, len(entity) // 2)) + attempt // GROW)) + ENDINGS[script][gender]


def in_format(kind: str, written: str, new: str) -> str:
    """A canonical surrogate in the form of one mention."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(new)
        return re.sub("[0-9]", lambda _: next(digits), written)
    if kind == "iban":
        letters = iter(new.upper())
        return re.sub("[A-Z0-9]", lambda _: next(letters), written)
    if kind.startswith("given") or kind == "surname":
        return new.upper() if written.isupper() else new.capitalize()
    return new.upper() if written.isupper() else new


def entities(docs: DataFrame) -> DataFrame:
    """``kind, entity`` of the whole corpus, each once; repeats go before the shuffle."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {(kind, entity) for text in batch["text"] for _, _, kind, entity in find(text)}
            yield pd.DataFrame(sorted(found), columns=["kind", "entity"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInPandas(collect, "kind string, entity string").distinct()


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, entity, attempt, surrogate``: no two entities of a kind share a surrogate, none is an entity itself."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["kind"], batch["entity"], batch["attempt"], strict=True)
            yield batch[["kind", "entity", "attempt"]].assign(surrogate=[surrogate(k, e, key, int(a)) for k, e, a in rows])

    fields = "kind string, entity string, attempt int, surrogate string"
    found = materialize(found, "entities")
    given = materialize(found.withColumn("attempt", F.lit(0)).mapInPandas(draw, fields), "surrogates")
    for _ in range(ROUNDS):
        first = given.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count("*").alias("n"))
        shared = given.join(first.where("n > 1"), ["kind", "surrogate"]).where("struct(attempt, entity) != first").select("kind", "entity")
        own = given.join(found.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"]).select("kind", "entity")
        again = materialize(shared.unionAll(own).distinct(), "again")
        if again.isEmpty():
            return given
        redrawn = given.join(again, ["kind", "entity"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        given = materialize(
            given.join(again, ["kind", "entity"], "left_anti").unionAll(redrawn.mapInPandas(draw, fields)), "surrogates",
        )
    raise RuntimeError(f"surrogates still meet after {ROUNDS} rounds")


def replace_pii(docs: DataFrame, key: bytes, spans: str = "pii_spans", count: str = "n_entities") -> DataFrame:
    """The documents with surrogates in ``text``, where they stand in the old text, and how many."""
    if not key:
        raise ValueError("surrogates need a secret key")
    given = assign(entities(docs), key)
    special = given.where("attempt > 0").select("kind", "entity", "surrogate")
    source = docs.withColumn("__lw_text", F.col("text").cast("string"))
    result = T.StructType([
        T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.StringType())), T.StructField("n", T.LongType()),
    ])

    def change(text: str | None, known: dict[tuple[str, str], str]) -> tuple[str | None, list[str], int]:
        found, parts, at = find(text), [], 0
        for start, end, kind, entity in found:
            new = known.get((kind, entity)) or surrogate(kind, entity, key)
            parts += [text[at:start], in_format(kind, text[start:end], new)]
            at = end
        return (text if not found else "".join([*parts, text[at:]])), [f"{k}:{s}:{e}" for s, e, k, _ in found], len(found)

    def as_frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["text", "spans", "n"])

    if special.isEmpty():

        @F.pandas_udf(result)
        def replaced(texts: pd.Series) -> pd.DataFrame:
            return as_frame([change(x, {}) for x in texts])

        out = source.withColumn("__lw_new", replaced("__lw_text"))
    else:

        @F.pandas_udf("array<struct<kind:string,entity:string>>")
        def mentioned(texts: pd.Series) -> pd.Series:
            return pd.Series([[{"kind": k, "entity": e} for k, e in sorted({(k, e) for _, _, k, e in find(x)})] for x in texts])

        # Documents are joined by what their text is, so rows without or with the same doc_id make no difference.
        sign = F.struct(F.xxhash64("__lw_text").alias("a"), F.md5("__lw_text").alias("b"))
        hits = source.select(sign.alias("__lw_sign"), F.explode(mentioned("__lw_text")).alias("m")).select("__lw_sign", "m.kind", "m.entity")
        lists = hits.distinct().join(special, ["kind", "entity"]).groupBy("__lw_sign").agg(
            F.collect_set(F.struct("kind", "entity", "surrogate")).alias("__lw_known"),
        )

        @F.pandas_udf(result)
        def replaced_known(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
            return as_frame([
                change(x, {} if k is None else {(m["kind"], m["entity"]): m["surrogate"] for m in k}) for x, k in zip(texts, known, strict=True)
            ])

        out = source.withColumn("__lw_sign", sign).join(lists, "__lw_sign", "left")
        out = out.withColumn("__lw_new", replaced_known("__lw_text", "__lw_known"))
    plain = [F.col("__lw_new.text").alias("text") if x == "text" else F.col(f"`{x}`") for x in docs.columns if x not in (spans, count)]
    return out.select(*plain, F.col("__lw_new.spans").alias(spans), F.col("__lw_new.n").alias(count))


QUERY_KEY = b"the key of the query; a job brings its own"


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data."""
    changed = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return changed.select("doc_id", "n_entities", F.array_join("pii_spans", ",").alias("spans"), "text")
