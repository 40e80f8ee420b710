"""Personal data and secrets replaced by keyed, type-consistent surrogates.

Detected entities get a surrogate of the same type and format: digits for
digits and letters for letters, grouping and separators kept, card numbers
with a valid check digit, names of the same gender and script from lists.  A
surrogate depends on the secret key, the type and the canonical form of the
entity, so the same person keeps one surrogate through the whole corpus
(coreference).  Distinctness is checked over all distinct entities: where two
would share a surrogate, or a surrogate is itself an entity of the corpus, all
but one draw again until none clash.

Only DataFrame functions.  Documents without entities are not shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import let, row_key, table, text_or_empty, written

KEY = "surrogate-key-1"     # stands for the caller's secret

# Titles with their gender, and surrogate names by script and gender.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Don", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Doña", "г-жа"],
    "n": ["Dr", "Prof"],
}
FIRST = {
    "latin": {
        "m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon",
              "Martin", "Noah", "Oscar", "Paul", "Robert", "Samuel", "Thomas", "Viktor"],
        "f": ["Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Hanna", "Irene", "Julia", "Karla",
              "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sara", "Teresa", "Vera"],
        "n": ["Alex", "Andrea", "Chris", "Dana", "Jo", "Kim", "Lee", "Lou", "Max", "Nicola", "Pat", "Robin", "Sam",
              "Sascha", "Toni", "Val"],
    },
    "cyrillic": {
        "m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел"],
        "f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Софья"],
        "n": ["Саша", "Женя", "Валя", "Слава", "Шура"],
    },
}
LAST = {
    "latin": ["Adler", "Baker", "Carter", "Dietz", "Engel", "Fischer", "Garner", "Hansen", "Ibarra", "Jansen", "Keller",
              "Lambert", "Moreno", "Nilsen", "Ortega", "Palmer", "Quinn", "Roth", "Serra", "Turner", "Ulrich", "Vidal",
              "Weber", "Yates", "Zeller"],
    "cyrillic": ["Белых", "Гринь", "Дорош", "Зинько", "Коваль", "Лисенко", "Мельник", "Орлик", "Пинчук", "Руденко",
                 "Сидоренко", "Ткач", "Усик", "Черных", "Шевчук", "Юрченко"],
}

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_NAME = r"\p{Lu}[\p{L}\p{M}'-]+"
#: In the order in which an entity is classified.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?i:(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9+/_-]{6,}+=*",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "name": rf"\b(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}\b"
             r"|(?:\([0-9]{3}\) ?|\b[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b(?!\.[0-9])",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap test that every text with an entity passes.
HINT = rf"[0-9@]|(?:{_TITLE})\.? \p{{Lu}}|(?i:password|passwd|pwd|token|secret|api[_-]?key)|AKIA|ASIA"
SECRET_HEAD = r"^(?i:(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)"
MAX_ROUNDS = 64     # each round settles almost all; more than this is a sign of an error


def entities_of(text: Column) -> Column:
    """All entities of a text in order (array of strings)."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def entity_type(entity: Column) -> Column:
    out = F.lit("card")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^((?:{_TITLE})\.? )", 1)


def entity_head(kind: Column, entity: Column) -> Column:
    """The part that stays: a name's title, the field name before a secret."""
    return (F.when(kind == "name", _title(entity))
            .when(kind == "secret", F.regexp_extract(entity, f"({SECRET_HEAD})", 1)).otherwise(""))


def _gender(head: Column) -> Column:
    word = F.regexp_replace(head, r"[. ]+$", "")
    out = F.lit("n")
    for g in ("m", "f"):
        out = F.when(word.isin(TITLES[g]), F.lit(g)).otherwise(out)
    return out


def canonical(kind: Column, head: Column, body: Column) -> Column:
    """One form for all spellings of an entity; names carry their gender and script."""
    script = F.when(body.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return (F.when(kind == "name", F.concat_ws("|", _gender(head), script, F.lower(body)))
            .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(body, "[^0-9+]", ""))
            .when(kind == "iban", F.replace(body, F.lit(" "), F.lit("")))
            .when(kind == "email", F.lower(body)).otherwise(body))


def _pick(options: list[str], seed: Column, salt: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]),
                        (F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))


def _by_character(canon: Column, seed: Column, hexadecimal: Column) -> Column:
    """Each character drawn anew from its own class; the rest stays."""
    chars = F.split(canon, "")

    def draw(c, i):
        r = F.xxhash64(seed, i)

        def of(alphabet: str):
            return F.substring(F.lit(alphabet), (F.pmod(r, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
        lead = (i == 0) | ~F.get(chars, i - 1).rlike("[0-9]")
        digits = F.when(lead, of("123456789")).otherwise(of("0123456789"))
        return (F.when(hexadecimal & c.rlike("[0-9a-f]"), of("0123456789abcdef"))
                .when(c.rlike("[0-9]"), digits)
                .when(c.rlike("[a-z]"), of("abcdefghijklmnopqrstuvwxyz"))
                .when(c.rlike("[A-Z]"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c))
    return F.array_join(F.transform(chars, draw), "")


def _luhn(digits: Column) -> Column:
    """``digits`` with its last digit replaced by the valid check digit."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)

    def weigh(c, i):
        d = c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    total = F.aggregate(F.transform(F.reverse(F.split(body, "")), weigh), F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def _names(canon: Column, seed: Column, attempt: Column) -> Column:
    parts = F.split(canon, r"\|")
    several = F.contains(parts[2], F.lit(" "))
    out = F.lit(None).cast("string")
    for script in FIRST:
        for g, firsts in FIRST[script].items():
            last = _pick(LAST[script], seed, 2)
            # repeated draws widen the space: a second, then further surnames
            last = F.when(attempt > 0, F.concat_ws("-", last, _pick(LAST[script], seed, 3))).otherwise(last)
            for k in range(4):
                last = F.when(attempt > 2 * k + 2, F.concat_ws("-", last, _pick(LAST[script], seed, 4 + k))).otherwise(last)
            name = F.when(several, F.concat_ws(" ", _pick(firsts, seed, 1), last)).otherwise(last)
            out = F.when((parts[0] == g) & (parts[1] == script), name).otherwise(out)
    return out


def surrogate(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """Candidate surrogate (canonical form) of an entity for its n-th draw."""
    seed = F.sha2(F.concat_ws("\0", F.lit(key), kind, canon, attempt.cast("string")), 256)
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (
        F.pmod(F.xxhash64(seed, i), F.when(i == 1, 223).otherwise(254)) + 1).cast("string")), ".")
    # the country of a phone or account number, the kind of an access key and a card's issuer stay
    keep = (F.when(kind == "phone", F.regexp_extract(canon, r"^(\+1)", 1))
            .when(kind.isin("iban"), F.substring(canon, 1, 2)).when(kind == "access_key", F.substring(canon, 1, 4))
            .when(kind == "card", F.substring(canon, 1, 1)).otherwise(""))
    end = F.when(kind == "email", F.regexp_extract(canon, r"(\.[^.]+)$", 1)).otherwise("")    # the top-level domain
    rest = F.substring(canon, F.length(keep) + 1, F.length(canon) - F.length(keep) - F.length(end))
    drawn = F.concat(keep, _by_character(rest, seed, (kind == "secret") & rest.rlike("^[0-9a-f]+$")), end)
    return (F.when(kind == "name", _names(canon, seed, attempt)).when(kind == "ip", ip)
            .when(kind == "card", _luhn(drawn)).otherwise(drawn))


def surrogate_table(distinct: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon) -> surrogate, distinct within each kind and never an entity.

    A round draws for all open entities; a draw stands if it is no entity of
    the corpus, no settled surrogate, and the smallest entity drew it.
    """
    entities = written(distinct.select("kind", "canon").distinct(), "pii-entities")
    # a name's surrogate is compared as it is written, not with gender and script
    shown = F.when(F.col("kind") == "name", F.element_at(F.split("canon", r"\|"), -1)).otherwise(F.col("canon"))
    taken = written(entities.select("kind", F.lower(shown).alias("drawn")).distinct(), "pii-taken")
    open_, settled = entities, []
    for attempt in range(MAX_ROUNDS):
        draws = written(open_.select("kind", "canon", surrogate(
            F.col("kind"), F.col("canon"), F.lit(attempt), key).alias("surrogate")), "pii-draws")
        free = draws.withColumn("drawn", F.lower("surrogate")).join(taken, ["kind", "drawn"], "leftanti")
        first = free.groupBy("kind", "drawn").agg(F.min(F.struct("canon", "surrogate")).alias("w"))
        won = written(first.select("kind", "drawn", F.col("w.canon").alias("canon"),
                                   F.col("w.surrogate").alias("surrogate")), "pii-settled")
        settled.append(won.select("kind", "canon", "surrogate"))
        open_ = written(draws.select("kind", "canon").join(won.select("kind", "canon"), ["kind", "canon"],
                                                           "leftanti"), "pii-open")
        if open_.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, settled)
        taken = taken.unionByName(won.select("kind", "drawn"))
    raise RuntimeError("surrogates still clash: widen the surrogate space")


def _shaped(kind: Column, body: Column, drawn: Column) -> Column:
    """The surrogate in the spelling of this place (separators as found)."""
    def refill(d):
        chars = F.split(body, "")
        keep = F.when(kind == "iban", "[A-Z0-9]").otherwise("[0-9+]")
        return F.array_join(F.aggregate(
            chars, F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out")),
            lambda a, c: F.when(F.regexp_like(c, keep), F.struct(
                (a["at"] + 1).alias("at"), F.concat(a["out"], F.array(F.substring(d, a["at"], F.lit(1)))).alias("out")))
            .otherwise(F.struct(a["at"].alias("at"), F.concat(a["out"], F.array(c)).alias("out"))),
            lambda a: a["out"]), "")
    return F.when(kind.isin("phone", "card", "ssn", "iban"), let(drawn, refill)).otherwise(drawn)


def replace_personal_data(docs: DataFrame, key: str = KEY, counts: bool = False) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced; all other columns stay.

    With ``counts`` also n_entities and entity_types (sorted, comma-joined).
    Defined results: null and empty texts stay as they are; repeated rows get
    equal texts; an empty table stays empty; other columns are carried along
    unchanged, whatever their names.  Runs jobs when called.
    """
    columns = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                      row_key().alias("key"), F.col("text").alias("body"))
    row = row.withColumn("entities", entities_of(text_or_empty("body")))
    # rows equal in id and text are rewritten once; every row finds the result by its key
    dirty = row.where(F.size("entities") > 0)
    texts = written(dirty.select("key", "body", "entities").dropDuplicates(["key"])
                    .select("key", "entities", F.split("body", ENTITY, -1).alias("gaps")), "pii-texts")
    hits = texts.select("key", F.posexplode("entities").alias("place", "entity"))
    hits = hits.withColumn("kind", entity_type(F.col("entity")))
    hits = hits.withColumn("head", entity_head(F.col("kind"), F.col("entity")))
    hits = hits.withColumn("tail", F.substring("entity", F.length("head") + 1, F.length("entity")))
    hits = written(hits.withColumn("canon", canonical(F.col("kind"), F.col("head"), F.col("tail"))), "pii-hits")
    table_ = surrogate_table(hits, key)
    named = hits.join(table_, ["kind", "canon"]).select("key", F.struct(
        "place", "kind", F.concat("head", _shaped(F.col("kind"), F.col("tail"), F.col("surrogate"))).alias("new"))
        .alias("h"))
    # bounded by the entities of one text
    new = named.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    pieces = F.zip_with("gaps", F.transform("hs", lambda h: h["new"]),
                        lambda g, n: F.concat(g, F.coalesce(n, F.lit(""))))
    fixed = written(texts.join(new, "key").select(
        F.col("key").alias("of"), F.array_join(pieces, "").alias("new_text"), F.size("hs").alias("n"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hs", lambda h: h["kind"]))), ",").alias("kinds")),
        "pii-fixed")
    done = dirty.select("row", "key").join(fixed, F.col("key") == F.col("of"))
    clean = row.where(F.size("entities") == 0)
    extra = [F.col("n").alias("n_entities"), F.col("kinds").alias("entity_types")] if counts else []
    none = [F.lit(0).alias("n_entities"), F.lit("").alias("entity_types")] if counts else []
    changed = done.select(*[(F.col("new_text") if c == "text" else F.col("row")[c]).alias(c) for c in columns], *extra)
    return changed.unionByName(clean.select("row.*", *none))


def op4_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
