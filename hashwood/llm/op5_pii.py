"""Surrogates for personal data, in DataFrame and SQL functions only.

One expression finds the candidates of a text; checks (Luhn, mod 97) decide which count. The HMAC of an entity's kind and
normal form gives a surrogate of the same kind: digits for digits in the same layout, valid card and account checks,
addresses in ranges reserved for examples, names of the same script and gender. The same entity so gets the same surrogate
wherever and however it is written. Distinct entities are then checked for equal surrogates, and for surrogates that are
some real entity; all but the least of these try again with a higher attempt until none are left. Only those with an
attempt above 0 are joined back. Expressions get the key from a scalar subquery, so that no plan shows it.

Defined results: a null text stays null and has no entities; an empty one stays empty; a very long one is searched as a
whole; rows are treated one by one, so repeats and ties stay; a null doc_id is kept; other columns are kept by
surrogates(), whatever their names, and left out by the query; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, written

#: Texts with an attempt above 0 that are broadcast at most, some 2 MB; more are joined by a shuffle.
BROADCAST_TEXTS = 10_000
#: The column that expressions take the key from.
HMAC = "hmac_key"
KINDS = ("email", "phone", "ipv4", "ipv6", "ssn", "card", "iban", "person")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_PART = r"[\p{L}\p{N}._%+-]"
# Forms of address and given names by gender.
TITLES = {"f": "Mrs|Ms|Miss|Lady|Dame|Frau|Señora|Sra|Madame|Mme|Mlle|Госпожа|Κυρία", "m": "Mr|Sir|Lord|Herr|Señor|Sr|Monsieur|Господин|Κύριος"}
NEUTRAL = "Dr|Prof|Professor|Doctor|Doktor|Docteur"
GIVEN = {
    "f": "Mary|Anna|Emma|Sarah|Laura|Julia|Maria|Sophie|Lucía|Carmen|Linda|Susan|Karen|Lisa|Nancy|Elizabeth|Jennifer|Patricia|Barbara|Jessica|Claudia|Petra|Ursula|Monika|Sabine|Isabel|Marie|Claire|Camille|Elena|Мария|Анна|Елена|Ольга|Ελένη|Μαρία",
    "m": "John|James|Peter|Thomas|Michael|Hans|Pierre|Carlos|José|David|Robert|William|Richard|Daniel|Paul|George|Charles|Joseph|Andrew|Stefan|Klaus|Wolfgang|Jürgen|Andreas|Luis|Juan|Miguel|Antonio|Jean|Jacques|Иван|Пётр|Сергей|Андрей|Γιώργος|Νίκος",
}
_TITLES, _GIVENS = "|".join([*TITLES.values(), NEUTRAL]), "|".join(GIVEN.values())
_NAME = r"\p{Lu}[\p{L}\p{M}'’-]+"
# Each part begins with what a single character rules out, as most places of a text are none of these.
PATTERN = "|".join(
    [
        rf"(?<!{_PART}){_PART}++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)+",
        "(?=[0-9(+])(?:"
        + "|".join(
            [
                rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
                r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
                r"(?<![0-9-])[0-9]{3}-[0-9]{2,3}-[0-9]{4}(?![0-9-])",
                r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])",
                r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
                r"(?<![0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9]|\.[0-9])",
                r"(?<![0-9/.,-])0[1-9][0-9]{1,3}[ /][0-9]{6,8}(?![0-9/-])",
            ]
        )
        + ")",
        r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f]{0,4}:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:])",
        r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
        rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME})?|(?:{_GIVENS}) {_NAME})",
    ]
)
# Letters of the scripts that names keep, vowels first so that names can be spoken.
ALPHABETS = {
    "[a-zß-öø-ÿĀ-ɏ]": ("aeiou", "bcdfghklmnprstvz", "a"),
    "[а-яёѐ-џ]": ("аеиоу", "бвгдзклмнпрст", "а"),
    "[ά-ώ]": ("αεηιο", "βγδκλμνπρστφ", "α"),
    "[א-ת]": ("אהוי", "בגדזחטכלמנסעפצקרשת", "ה"),
    "[ء-ي]": ("اوي", "بتجدرزسشعفقكلمنه", "ة"),
    "[ぁ-ん]": ("あいうえおかきくけこ", "さしすせそたてとなにのはまみ", "み"),
    "[ァ-ン]": ("アイウエオカキクケコ", "サシスセソタテトナニノハマミ", "ミ"),
    "[가-힣]": ("가나다라마바사아자하", "강건경길동민석수영은정준현", "미"),
    "[一-鿿]": ("安伯承德方高国海和华", "建江杰林明宁平清文志", "芳"),
}


def _q(text: str) -> str:
    """text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _solid(x: str) -> str:
    return f"replace({x}, ' ', '')"


def _luhn(digits: str) -> str:
    return f"aggregate(transform(sequence(1, greatest(1, length({digits}))), i -> coalesce(try_cast(substr(reverse({digits}), i, 1) as int), 0) * if(i % 2 = 0, 2, 1)), 0, (a, x) -> a + x - if(x > 9, 9, 0)) % 10"


def _mod97(account: str) -> str:
    moved = f"concat(substr({account}, 5), substr({account}, 1, 4))"
    return f"aggregate(transform(sequence(1, greatest(1, length({moved}))), i -> substr({moved}, i, 1)), 0, (a, c) -> if(c between '0' and '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))"


def kind_sql(m: str) -> str:
    """The kind of a candidate; null for one that fails its check."""
    plain = _digits(m)
    return f"""CASE WHEN {m} LIKE '%@%' THEN 'email'
        WHEN {m} RLIKE '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$' THEN 'ipv4'
        WHEN {m} LIKE '%:%' THEN 'ipv6'
        WHEN {m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'
        WHEN {m} RLIKE '^([0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$|0[0-9]{{2,4}}[ /][0-9]{{6,8}}$|[+(])' THEN 'phone'
        WHEN {m} RLIKE '^[0-9 -]+$' THEN if({_luhn(plain)} = 0 AND {plain} RLIKE '[1-9]', 'card', null)
        WHEN {m} RLIKE '^[A-Z]{{2}}[0-9]{{2}}' THEN if({_mod97(_solid(m))} = 1, 'iban', null)
        ELSE 'person' END"""


def names_sql(m: str) -> str:
    """A person's names without the form of address."""
    return f"split(regexp_replace({m}, {_q('^(' + _TITLES + ')[.]? ')}, ''), ' ')"


def gender_sql(m: str) -> str:
    female, male = (f"^({TITLES[g]})[.]? |^(({NEUTRAL})[.]? )?({GIVEN[g]}) " for g in "fm")
    return f"CASE WHEN {m} RLIKE {_q(female)} THEN 'f' WHEN {m} RLIKE {_q(male)} THEN 'm' ELSE '' END"


def parts_sql(m: str) -> str:
    """The entities in a candidate as (kind, normal form): one, or a person's given name with gender and surname."""
    kind = kind_sql(m)
    one = f"""CASE {kind} WHEN 'email' THEN lower({m}) WHEN 'ipv6' THEN lower({m}) WHEN 'ipv4' THEN {m} WHEN 'iban' THEN {_solid(m)}
        WHEN 'phone' THEN concat(if({m} LIKE '+%', '+', ''), {_digits(m)}) ELSE {_digits(m)} END"""
    people = f"transform({names_sql(m)}, (w, i) -> struct(if(i = 0 AND size({names_sql(m)}) = 2, concat('given', {gender_sql(m)}), 'surname') AS kind, lower(w) AS entity))"
    return f"CASE WHEN {kind} IS NULL THEN array() WHEN {kind} = 'person' THEN {people} ELSE array(struct({kind} AS kind, {one} AS entity)) END"


def key_column(spark: SparkSession, key: str) -> Column:
    """The two blocks of HMAC-SHA256 that a key makes, as a struct of the binary fields inner and outer."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in raw).hex() for pad in (0x36, 0x5C))
    return spark.sql("SELECT struct(inner, outer) FROM VALUES (unhex(:inner), unhex(:outer)) AS given(inner, outer)", {"inner": inner, "outer": outer}).scalar()


def _stream(kind: str, entity: str, attempt: str) -> str:
    """Hex digits that the key, the entity and the attempt decide, four for each character."""
    said = f"encode(concat({kind}, '|', {attempt}, '|', b, '|', {entity}), 'UTF-8')"
    return f"array_join(transform(sequence(0, length({entity}) div 16 + 1), b -> sha2(concat({HMAC}.outer, unhex(sha2(concat({HMAC}.inner, {said}), 256))), 256)), '')"


def _draw(i: str, stream: str = "s") -> str:
    """A number below 65,536 for the place i from 1."""
    return f"cast(conv(substr({stream}, 4 * ({i}) - 3, 4), 16, 10) as int)"


def _each(entity: str, of: str) -> str:
    """Characters of entity, each through the SQL of c and i."""
    return f"array_join(transform(sequence(1, length({entity})), i -> aggregate(array(substr({entity}, i, 1)), '', (z, c) -> {of})), '')"


def _name(entity: str, female: str) -> str:
    cases = []
    for letters, (vowels, others, last) in ALPHABETS.items():
        pick = lambda xs: f"substr({_q(xs)}, {_draw('i')} % {len(xs)} + 1, 1)"
        # Vowels and others take turns; a woman's given name ends in its script's usual letter, a man's never does.
        cases.append(f"WHEN c RLIKE {_q(letters)} THEN CASE WHEN i = length({entity}) AND {female} = 'f' THEN {_q(last)} WHEN i = length({entity}) AND {female} = 'm' THEN {pick(others)} WHEN i % 2 = 0 THEN {pick(vowels)} ELSE {pick(others)} END")
    return _each(entity, f"CASE {' '.join(cases)} ELSE c END")


def surrogate_sql(kind: str, entity: str, attempt: str) -> str:
    """The surrogate's normal form.

    From the fourth attempt on it comes from a wider range (any address or number, longer names), so that there are always
    more surrogates than entities and attempts() ends.
    """
    late = f"cast({attempt} as int) >= 4"
    number = f"cast({_draw('i')} % 10 as string)"
    letters = f"CASE WHEN c BETWEEN '0' AND '9' THEN {number} WHEN c RLIKE '[a-z]' THEN char(97 + {_draw('i')} % 26) WHEN c RLIKE '[._%+-]' THEN c ELSE char(97 + {_draw('i')} % 26) END"
    local = f"substring_index({entity}, '@', 1)"
    email = f"concat({_each(local, letters)}, '@mail', {_draw('length(' + local + ') + 1')} % 1000, '.example.', element_at(array('com', 'org', 'net'), {_draw('length(' + local + ') + 2')} % 3 + 1))"
    phone = _each(entity, f"CASE WHEN c = '+' OR (i = 2 AND {entity} LIKE '+%') OR (i = 1 AND c = '0') THEN c WHEN i = 1 OR (i = 3 AND {entity} LIKE '+%') THEN cast({_draw('i')} % 8 + 2 as string) ELSE {number} END")
    ipv4 = f"concat_ws('.', if({late}, {_draw('4')} % 223 + 1, 10), {_draw('1')} % 256, {_draw('2')} % 256, {_draw('3')} % 254 + 1)"
    ipv6 = f"concat('fd00:', array_join(transform(sequence(1, 7), i -> substr(s, 4 * i - 3, 4)), ':'))"
    ssn = f"concat(if({late}, {_draw('16')} % 10, 9), {_each('substr(' + entity + ', 2)', number)})"
    body = f"concat(substr({entity}, 1, 1), {_each('substr(' + entity + ', 2, length(' + entity + ') - 2)', number)})"
    card = f"aggregate(array({body}), '', (z, d) -> concat(d, (10 - {_luhn('concat(d, chr(48))')}) % 10))"
    account = _each(f"substr({entity}, 5)", f"CASE WHEN c BETWEEN '0' AND '9' THEN {number} ELSE char(65 + {_draw('i')} % 26) END")
    iban = f"aggregate(array({account}), '', (z, d) -> concat(substr({entity}, 1, 2), lpad(98 - {_mod97('concat(substr(' + entity + ', 1, 2), chr(48), chr(48), d)')}, 2, '0'), d))"
    longer = f"if({late}, concat({entity}, repeat(substr({entity}, 1, 1), cast({attempt} as int) div 4)), {entity})"
    name = f"aggregate(array({longer}), '', (z, e) -> {_name('e', 'substr(' + kind + ', 6, 1)')})"
    cases = {"email": email, "phone": phone, "ipv4": ipv4, "ipv6": ipv6, "ssn": ssn, "card": card, "iban": iban}
    chosen = " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items())
    return f"aggregate(array({_stream(kind, entity, attempt)}), '', (y, s) -> CASE {kind} {chosen} ELSE {name} END)"


def _fill(layout: str, digits: str) -> str:
    """digits in the layout of a text: each of its digits gives way to the next of them."""
    return f"array_join(transform(sequence(1, length({layout})), i -> if(substr({layout}, i, 1) BETWEEN '0' AND '9', substr({digits}, length({_digits('substr(' + layout + ', 1, i)')}), 1), substr({layout}, i, 1))), '')"


def _spaced(layout: str, chars: str) -> str:
    """chars with spaces where a text has them."""
    return f"array_join(transform(sequence(1, length({layout})), i -> if(substr({layout}, i, 1) = ' ', ' ', substr({chars}, length({_solid('substr(' + layout + ', 1, i)')}), 1))), '')"


def _cased(word: str, new: str) -> str:
    """A name as the original is written: capitals throughout, or the first."""
    return f"CASE WHEN length({word}) > 1 AND {word} = upper({word}) AND {word} <> lower({word}) THEN upper({new}) ELSE concat(upper(substr({new}, 1, 1)), substr({new}, 2)) END"


def replaced_sql(m: str, attempts: str, surrogate=surrogate_sql) -> str:
    """What stands for a candidate; itself if it fails its check. attempts: a map from kind and entity."""
    new = f"transform({parts_sql(m)}, p -> {surrogate('p.kind', 'p.entity', 'cast(coalesce(try_element_at(' + attempts + chr(44) + ' concat(p.kind, chr(32), p.entity)), 0) as string)')})"
    title = f"regexp_extract({m}, {_q('^((' + _TITLES + ')[.]? )')}, 1)"
    person = f"concat({title}, array_join(zip_with({names_sql(m)}, n, (w, x) -> {_cased('w', 'x')}), ' '))"
    kind = kind_sql(m)
    return f"""aggregate(array({new}), '', (q, n) -> CASE WHEN size(n) = 0 THEN {m}
        ELSE CASE {kind} WHEN 'person' THEN {person} WHEN 'phone' THEN {_fill(m, _digits('n[0]'))}
        WHEN 'card' THEN {_fill(m, 'n[0]')} WHEN 'ssn' THEN {_fill(m, 'n[0]')} WHEN 'iban' THEN {_spaced(m, 'n[0]')} ELSE n[0] END END)"""


def with_candidates(texts: DataFrame) -> DataFrame:
    return texts.withColumn("found", F.expr(f"coalesce(regexp_extract_all(text, {_q(PATTERN)}, 0), array())"))


def candidates(docs: DataFrame) -> DataFrame:
    """digest (MD5) and found, of the texts that have any."""
    return with_candidates(docs.select("text")).where("size(found) > 0").select(F.md5("text").alias("digest"), "found")


def entities(searched: DataFrame) -> DataFrame:
    """Distinct (kind, entity) over all candidates."""
    found = searched.select(F.explode("found").alias("m")).distinct()
    return found.select(F.expr(f"inline({parts_sql('m')})")).distinct()


def attempts(found: DataFrame, key: str, surrogate=surrogate_sql) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate was another's, or was a real entity."""
    blocks = key_column(found.sparkSession, key)
    keyed = lambda df: df.withColumn(HMAC, blocks)
    real = written(found, "entities", release=True)
    state = written(keyed(real).selectExpr("kind", "entity", "0 attempt", f"{surrogate('kind', 'entity', chr(39) + '0' + chr(39))} surrogate"), "surrogates", release=True)
    while True:
        taken = state.groupBy("kind", "surrogate").agg(F.min(F.struct(F.expr("attempt"), F.expr("entity"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", F.col("first.entity").alias("owner"))
        marked = state.join(taken, ["kind", "surrogate"], "left").join(real.toDF("kind", "surrogate").withColumn("real", F.lit(True)), ["kind", "surrogate"], "left")
        bad = "(owner IS NOT NULL AND owner <> entity) OR real"
        clash = written(marked.where(bad).select("kind", "entity", F.expr("attempt + 1").alias("attempt")), "clashes", release=True)
        if clash.isEmpty():
            break
        again = keyed(clash).selectExpr("kind", "entity", "attempt", f"{surrogate('kind', 'entity', 'cast(attempt as string)')} surrogate")
        before, state = state, written(state.join(clash.select("kind", "entity"), ["kind", "entity"], "left_anti").select("kind", "entity", "attempt", "surrogate").union(again), "surrogates", release=True)
        drop_written(before)
    return state.where("attempt > 0").select("kind", "entity", "attempt")


def replaced(docs: DataFrame, key: str, surrogate=surrogate_sql) -> DataFrame:
    """row (a struct of the columns of docs), text with surrogates, and kinds, of the candidates in order (null for one that failed its check)."""
    # The caller's columns travel in one struct, so that none of their names can clash.
    found = with_candidates(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")))
    searched = written(candidates(docs), "candidates", release=True)
    higher = written(attempts(entities(searched), key, surrogate), "attempts", release=True)
    none = "cast(map() as map<string, int>)"
    if higher.isEmpty():
        found = found.withColumn("attempts", F.expr(none))
    else:
        # By text, as equal texts need the same attempts; a digest stands for it.
        inside = searched.select("digest", F.expr("explode(found) m")).distinct().select("digest", F.expr(f"inline({parts_sql('m')})"))
        by_text = inside.distinct().join(higher, ["kind", "entity"]).groupBy("digest").agg(F.expr("map_from_entries(collect_list(struct(concat(kind, ' ', entity), attempt)))").alias("attempts"))
        by_text = written(by_text, "attempts", release=True)
        if by_text.count() <= BROADCAST_TEXTS:
            by_text = F.broadcast(by_text)
        found = found.withColumn("digest", F.md5("text")).join(by_text, "digest", "left").withColumn("attempts", F.expr(f"coalesce(attempts, {none})"))
    new = f"transform(found, m -> {replaced_sql('m', 'attempts', surrogate)})"
    text = f"if(size(found) = 0 OR text IS NULL, text, array_join(flatten(zip_with(split(text, {_q(PATTERN)}, -1), {new}, (a, b) -> array(a, coalesce(b, '')))), ''))"
    kinds = f"coalesce(transform(found, m -> {kind_sql('m')}), array())"
    return found.withColumn(HMAC, key_column(docs.sparkSession, key)).select("row", F.expr(text).alias("text"), F.expr(kinds).alias("kinds"))


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with the entities in text replaced."""
    return replaced(docs, key).select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")


def pii(docs: DataFrame, key: str) -> DataFrame:
    """Per row: doc_id, the text with surrogates, its digest, and how many entities of each kind it had."""
    counts = [F.expr(f"cast(size(filter(kinds, k -> k = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    found = replaced(docs.select("doc_id", "text"), key)
    return found.select("row.doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), *counts)
