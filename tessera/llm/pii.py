"""Surrogates for personal data, in DataFrame operations only.

One pattern finds mail addresses, IPv4 addresses, IBANs, social security numbers, phone
and card numbers, and names after a title. It runs once over each text; texts without a find
go on as they are. In a text with names, later mentions of any part of them, without a title,
are found too. Every entity is reduced to a norm (digits without separators, lower case, a
name's parts one by one), and a keyed hash of the norm gives its surrogate: of the same kind,
format, case and script, names of the same gender, card numbers and IBANs with valid check
digits where the original has them. Thus an entity has one surrogate in all documents,
however it is written.

A given name that stands after titles of several genders (Dr and Mrs) has the one that is
more frequent in the corpus, of a tie the female one; a title that tells none has no vote.

Distinct entities must not meet. Over the distinct norms of the corpus, a surrogate that
another norm has too, or that is itself a norm, goes to the least norm only, or to none;
the others try again with another hash, until all differ. Only where a format has no room
left (``STUCK`` rounds that place none) a hash is added, which breaks the format and not
the distinctness. Rare overrides are looked up by text, of texts with finds only.

Null texts stay null and have no entities; repeated rows are rewritten alike; other columns
stay as they are, whatever their names, but for those that n_<kind> replaces; of matches that
begin at one place the first kind in PATTERNS counts; a mention that is part of several names
follows the first; an empty table gives an empty result. Patterns read a run of characters
once, so long texts take time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .quality import _let
from .shared import materialise

#: Titles by gender, and the names that surrogates are taken from.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "г-жа"), "m": ("Mr", "Mister", "Herr", "Señor", "Sr", "Monsieur", "г-н"), "n": ("Dr", "Prof")}
NAMES = {
    "given|f|latin": "Alice Anna Carla Clara Diana Elena Emma Eva Fiona Greta Hanna Helen Irene Julia Laura Lena Lucy Maria Marta Nina Nora Olga Paula Rita Rosa Ruth Sara Sofia Tina Vera Wanda Zoe".split(),
    "given|m|latin": "Adam Alan Boris Bruno Carl David Dennis Edgar Emil Felix Frank Georg Henry Hugo Igor Ivan Jack Jonas Karl Leo Luis Marco Martin Oscar Otto Paul Peter Ralph Simon Thomas Victor Walter".split(),
    "given|n|latin": "Alex Andrea Ariel Charlie Chris Dana Eden Jamie Jean Jo Kay Kim Lee Lou Marion Max Mika Morgan Nicky Noel Pat Quinn Robin Sam Sasha Shannon Sidney Terry Toni Tracy Val Winter".split(),
    "surname|latin": "Abel Acker Adler Albrecht Amberg Arnold Bach Bauer Becker Berger Blake Bond Brandt Brook Burke Carter Castle Conrad Dale Dean Drake Ebert Eckert Ellis Falk Fisher Forster Frost Garner Graf Grant Haas Hale Hardy Hart Heller Hill Holt Hunter Jansen Keller Kent Lang Lind Lorenz Marsh Maurer Miller Moore Moser Nash Noble Page Parker Pohl Reed Roth Sander Stone Vogel Ward Weber Wolf Young".split(),
    "given|f|cyrillic": "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Раиса Софья Тамара".split(),
    "given|m|cyrillic": "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Леонид Максим Никита Олег Павел Роман Степан".split(),
    "given|n|cyrillic": "Женя Саша Валя Шура Слава Паша Саня Вася Геня Лера Миша Никита Рома Сима Тоша Юля".split(),
    "surname|cyrillic": "Азаренко Бондаренко Власенко Гончаренко Доценко Ермоленко Жук Зинченко Игнатенко Коваль Лысенко Мороз Назаренко Остапенко Павленко Романенко".split(),
}
LETTERS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "latin": "abcdefghijklmnopqrstuvwxyz"}
_cases = lambda ts: "|".join(dict.fromkeys(x for t in sorted(ts, key=len, reverse=True) for x in (t, t.upper())))
_TITLE = "(?:" + _cases(t for ts in TITLES.values() for t in ts) + ")"
_PART = r"\p{Lu}\p{L}++(?:['’-]\p{L}{2,}+)*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}]++(?:-++[\p{L}\p{N}]++)*+(?:\.[\p{L}\p{N}]++(?:-++[\p{L}\p{N}]++)*+)++",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[-. ]?\d{4}(?!\d)|(?<!\d)\d{3}[-.]\d{3}[-.]\d{4}(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<!\p{{L}}){_TITLE}\.? {_PART}(?: {_PART}){{0,2}}",
}
KINDS = tuple(PATTERNS)
#: All kinds but addresses with an at sign begin with one of few characters, which spares most places a trial.
PLAIN = "(?=[0-9+(" + "".join(sorted({t[0] for ts in TITLES.values() for t in ts} | set("ABCDEFGHIJKLMNOPQRSTUVWXYZ") | {"Г"})) + "])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email") + ")"
ANY = f"(?:{PATTERNS['email']})|{PLAIN}"
STUCK = 3


def _pick(options: list[str] | str, at: Column) -> Column:
    """One of a list of words, or of the letters of a string."""
    at = (at % len(options)).cast("int") + 1
    return F.substring(F.lit(options), at, F.lit(1)) if isinstance(options, str) else F.element_at(F.split(F.lit(" ".join(options)), " "), at)


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substring(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def kind_of(e: Column) -> Column:
    return (
        F.when(e.contains("@"), "email").when(e.rlike(rf"^{_TITLE}\.? ") | e.rlike(rf"^{_PART}$"), "name").when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(e.rlike(r"^[\d]{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(e.rlike(r"^[+(]|^\d{3}[-.]\d{3}[-.]\d{4}$"), "phone").otherwise("card")
    )


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _name_parts(e: Column) -> Column:
    return F.split(F.regexp_replace(e, rf"^{_TITLE}\.? ", ""), " ")


def _titled(e: Column) -> Column:
    return e.rlike(rf"^{_TITLE}\.? ")


def _unit(kind: Column, norm: Column) -> Column:
    return F.struct(kind.alias("kind"), norm.alias("norm"))


def units(e: Column, people: Column | None = None) -> Column:
    """The (kind, norm) of which an entity is made: one, or one for each part of a name.

    ``people`` has those of the names in the text, by which a mention without a title is known.
    """
    gender = F.lit("n")
    for g in "fm":
        gender = F.when(e.rlike("^(?:" + _cases(TITLES[g]) + r")\.? "), g).otherwise(gender)
    parts, kind = _name_parts(e), kind_of(e)
    name = F.transform(parts, lambda p, i: _unit(F.when(i == F.size(parts) - 1, F.concat(F.lit("surname|"), _script(p))).otherwise(F.concat(F.lit("given|"), gender, F.lit("|"), _script(p))), F.lower(p)))
    if people is not None:
        known = F.slice(F.filter(people, lambda u: u["norm"] == F.lower(e)), 1, 1)
        name = F.when(_titled(e), name).otherwise(known)
    norm = F.when(kind == "email", F.lower(e)).when(kind == "ip", e).otherwise(F.regexp_replace(e, r"[^\p{L}\p{N}+]", ""))
    return F.when(kind == "name", name).otherwise(F.array(_unit(kind, norm)))


def _joined(n: Column, of) -> Column:
    return F.when(n <= 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: of(i).cast("string")), ""))


def _several(names, h: Column, n: Column) -> Column:
    """``n`` names with hyphens, so that later attempts have more to choose from."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(names, _byte(h, i * 2) * 256 + _byte(h, i * 2 + 1))), "-")


def _disguised(text: Column, h: Column) -> Column:
    """Letters of the same script and digits in the places of letters and digits."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(h, i)
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike(r"\p{IsCyrillic}"), _pick(LETTERS["cyrillic"], b)).when(c.rlike(r"\p{IsGreek}"), _pick(LETTERS["greek"], b)).when(c.rlike(r"\p{L}|\p{N}"), _pick(LETTERS["latin"], b)).otherwise(c)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def _luhn_sum(digits: Column) -> Column:
    """Of digits whose check digit, the last, is included."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """Of an IBAN whose first four characters stand last."""

    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a norm in the form of a norm, names capitalised."""
    secret = F.concat_ws("\0", F.lit(key), kind, attempt.cast("string"))
    hashed = lambda *x: F.concat(F.sha2(F.concat_ws("\0", secret, *x, F.lit("1")).cast("binary"), 256), F.sha2(F.concat_ws("\0", secret, *x, F.lit("2")).cast("binary"), 256))
    n = F.length(norm)

    def by_hash(h: Column) -> Column:
        digits = lambda m: _joined(m, lambda i: _byte(h, i) % 10)
        # The international form keeps its first digit; the next is none of 0 and 1.
        plus = F.when(norm.startswith("+"), 2).otherwise(0)
        phone = F.concat(F.substring(norm, F.lit(1), plus), F.lit(2) + _byte(h, F.lit(62)) % 8, digits(n - plus - 1))
        body = F.concat(F.substring(norm, 1, 1), digits(n - 2))
        check = (F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
        card = F.concat(body, F.when(_luhn_sum(norm) % 10 == 0, check).otherwise(_byte(h, F.lit(63)) % 10).cast("string"))
        ip = F.concat_ws(".", (_byte(h, F.lit(0)) % 223 + 1).cast("string"), *[_byte(h, F.lit(i)).cast("string") for i in (1, 2, 3)])
        country, account = F.substring(norm, 1, 2), F.upper(_disguised(F.substring(norm, F.lit(5), n), h))
        iban = F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
        local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
        top = F.substring_index(domain, ".", -1)
        host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
        of_domain = F.sha2(F.concat_ws("\0", F.lit(key), F.lit("domain"), domain).cast("binary"), 256)
        longer = F.substring(F.translate(h, "0123456789", "ghijklmnop"), F.lit(1), attempt)
        email = F.concat(_disguised(local, h), longer, F.lit("@"), _let(F.concat(of_domain, of_domain), lambda d: _disguised(host, d)), top)
        out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "ssn", F.concat(F.lit("9"), digits(n - 1))).when(kind == "phone", phone).when(kind == "card", card)
        for k, names in NAMES.items():
            out = out.when(kind == k, _several(names, h, attempt + 1))
        return out

    return _let(hashed(norm), by_hash)


def _filled(e: Column, canon: Column) -> Column:
    """``canon`` in the format of ``e``: its characters in the places of letters, digits and plus."""

    def add(acc: Column, c: Column) -> Column:
        part = c.rlike(r"[\p{L}\p{N}+]")
        return F.struct((acc["at"] + part.cast("int")).alias("at"), F.concat(acc["out"], F.when(part, F.substring(canon, acc["at"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(e, ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), add, lambda acc: acc["out"])


def _unit_key(kind: Column, norm: Column) -> Column:
    return F.concat(kind, F.lit("\0"), norm)


def rewritten(e: Column, key: str, people: Column, overrides: Column) -> Column:
    """The surrogate of one entity as it is written there."""

    def canon(u: Column) -> Column:
        return F.coalesce(F.element_at(overrides, _unit_key(u["kind"], u["norm"])), surrogate(u["kind"], u["norm"], F.lit(0), key))

    def by_parts(parts: Column) -> Column:
        first, kind = parts[0], kind_of(e)
        loud = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
        email = F.when(loud(e), F.upper(first)).otherwise(first)
        old, title = _name_parts(e), F.regexp_extract(e, rf"^({_TITLE}\.? )", 1)
        name = F.array_join(F.transform(parts, lambda p, i: F.when(loud(F.get(old, i)), F.upper(p)).otherwise(p)), " ")
        return F.when(kind == "email", email).when(kind == "ip", first).when(kind == "name", F.concat(title, name)).when(F.length(F.regexp_replace(e, r"[^\p{L}\p{N}+]", "")) == F.length(first), _filled(e, first)).otherwise(first)

    return _let(F.transform(units(e, people), canon), by_parts)


def _found(text: Column) -> Column:
    """The entities of a text in its order, names with their titles; none for null."""
    all_ = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(F.when(text.contains("@"), all_(ANY)).otherwise(all_(PLAIN)), F.array().cast("array<string>"))


def known_entities(found: DataFrame) -> DataFrame:
    """The distinct (kind, norm) and their number in rows with the array ``found``; counted before they are shuffled."""
    return found.select(F.explode("found").alias("e")).select(F.inline(units(F.col("e")))).groupBy("kind", "norm").agg(F.count("*").alias("n"))


def entities(df: DataFrame, text_col: str) -> DataFrame:
    """The distinct (kind, norm) of all texts."""
    return known_entities(df.select(_found(F.col(text_col)).alias("found")))


def one_gender(known: DataFrame) -> DataFrame:
    """kind, norm, as_kind of given names that stand under several genders; as_kind is what all of them follow."""
    given = known.where("kind LIKE 'given|%'").withColumn("script", F.substring_index("kind", "|", -1))
    vote = F.struct((~F.col("kind").startswith("given|n")).alias("told"), "n", F.col("kind").startswith("given|f").alias("female"), "kind")
    best = given.groupBy("script", "norm").agg(F.max(vote)["kind"].alias("as_kind"), F.count("*").alias("kinds")).where("kinds > 1")
    return given.join(best, ["script", "norm"]).where("kind != as_kind").select("kind", "norm", "as_kind")


def overrides(known: DataFrame, key: str) -> DataFrame:
    """kind, norm, canon of the norms whose first surrogate another norm has, or is, or whose kind another takes over."""
    led = materialise(one_gender(known), "genders")
    todo = materialise(known.join(led, ["kind", "norm"], "left_anti").select("kind", "norm"), "norms")
    norms, settled, idle, attempt = known.select("kind", F.col("norm").alias("low")).distinct(), [], 0, 0
    while not todo.isEmpty():
        canon = surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key)
        if idle >= STUCK:  # a space that is full: distinctness comes before format
            canon = F.concat(canon, F.lit("-"), F.sha2(F.concat_ws("\0", F.lit(key), "kind", "norm").cast("binary"), 256))
        tried = todo.withColumn("canon", canon).withColumn("low", F.lower("canon"))
        free = tried.join(norms, ["kind", "low"], "left_anti")
        for before in settled:
            free = free.join(before.select("kind", F.lower("canon").alias("low")), ["kind", "low"], "left_anti")
        won = free.groupBy("kind", "low").agg(F.min(F.struct("norm", "canon")).alias("x")).select("kind", "x.norm", "x.canon")
        won = materialise(won, "surrogates")
        idle = idle + 1 if won.isEmpty() else 0
        settled.append(won)
        todo, attempt = materialise(todo.join(won, ["kind", "norm"], "left_anti"), "collided"), attempt + 1
        if len(settled) > 8:  # few tables to look into, whatever the number of rounds
            settled = [settled[0], materialise(_union(settled[1:]), "surrogates")]
    if not settled:
        return known.select("kind", "norm", F.lit("").alias("canon"))
    first = settled[0]
    later = _union(settled[1:]) if settled[1:] else first.where("false")
    leaders = led.select(F.col("as_kind").alias("kind"), "norm").distinct()
    lead = first.unionByName(later).join(leaders, ["kind", "norm"], "left_semi").withColumnRenamed("kind", "as_kind")
    return materialise(later.unionByName(led.join(lead, ["as_kind", "norm"]).select("kind", "norm", "canon")), "overrides")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def pseudonymised(df: DataFrame, text_col: str, key: str, counts: bool = True) -> DataFrame:
    """``df`` with its texts rewritten under ``key`` and, if ``counts``, the entities of each kind in n_<kind>.

    Whoever has the key can tell which original a surrogate stands for, by trying; keep it secret.
    """
    text = F.col("row").getField(text_col)
    rows = df.select(F.struct("*").alias("row"), _found(F.col(text_col)).alias("found"))
    rows = materialise(rows, "found")
    plain, marked = rows.where("size(found) = 0"), rows.where("size(found) > 0")
    extra = overrides(materialise(known_entities(marked.select("found")), "entities"), key)
    people = F.flatten(F.transform(F.filter("found", _titled), lambda e: units(e)))
    names = F.array_distinct(F.flatten(F.transform(F.filter("found", _titled), _name_parts)))
    names = F.array_distinct(F.concat(names, F.transform(names, F.initcap), F.transform(names, F.upper)))
    mention = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))
    marked = marked.select("row", people.alias("people"), F.when(F.size(names) > 0, mention).otherwise(F.lit(ANY)).alias("pattern"), F.md5(text).alias("of"), "found")
    used = marked.select("of", F.explode(F.flatten(F.transform("found", lambda e: units(e)))).alias("u")).distinct()
    used = used.select("of", "u.kind", "u.norm").join(extra, ["kind", "norm"])
    pairs = F.collect_list(F.struct(_unit_key(F.col("kind"), F.col("norm")).alias("k"), F.col("canon").alias("v")))
    maps = materialise(used.groupBy("of").agg(F.map_from_entries(pairs).alias("other")), "maps")
    marked = marked.drop("found").join(maps, "of", "left")
    other = F.coalesce("other", F.create_map().cast("map<string,string>"))

    def replaced(found: Column) -> Column:
        new = F.transform(found, lambda e: rewritten(e, key, F.col("people"), other))
        parts = F.split(text, F.col("pattern"), -1)
        whole = _let(new, lambda s: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(s, i), F.lit("")))), ""))
        return F.struct(whole.alias("new"), F.transform(found, kind_of).alias("kinds"))

    # Generating the result keeps the work from being repeated for every use of it.
    found = F.regexp_extract_all(text, F.col("pattern"), F.lit(0))
    done = marked.select("row", F.inline(F.transform(F.array(found), replaced)))
    done = done.unionByName(plain.select("row", text.alias("new"), F.array().cast("array<string>").alias("kinds")))
    number = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).alias(f"n_{kind}")
    numbers = [number(kind) for kind in KINDS] if counts else []
    taken = {f"n_{kind}" for kind in KINDS} if counts else set()
    return done.select(*[F.col("new").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns if c not in taken], *numbers)
