"""Operator 7: format-preserving Feistel pseudonyms for personal numbers and dates, in DataFrame operations only.

A value that a pattern finds and its check admits is read as digits of a mixed radix, sent through an alternating Feistel
network keyed by SHA-256, and written back in its own format. The network is a permutation of the format's values, so
equal values stay equal in every document and different ones stay different; with the key it can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The session setting that names the secret key. op7_pseudonyms falls back to a public key, which protects nothing, where
#: it is unset, so that the query runs anywhere; the operator has no default.
KEY_SETTING, PUBLIC_KEY = "wayfold.pseudonyms.key", "public"
#: Days of the dates that are permuted: 1900-01-01 and the next 73,048, to 2099-12-31.
DAYS, DAY_BASE, DAY_RADIX = 73_049, "1900-01-01", (271, 270)

EMAIL = r"(?<![\w.+-])[A-Za-z0-9._+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,63}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
PHONE = r"(?<![\d(+-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
KINDS = {"email": EMAIL, "ip": IP, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
#: The look-ahead leaves the alternatives untried at nearly every place.
ANY = r"(?=[0-9+(]|(?<![\w.+-])[A-Za-z0-9._+-]{1,64}+@)(?:" + "|".join(KINDS.values()) + ")"


def _array(*items) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, int) else x for x in items]).cast("array<int>")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(values: Column, sizes: Column, key: str, kind: str) -> Column:
    """Permute an array of numbers, the i-th below sizes[i]: each round adds a digest of one half to the other half."""

    def step(v: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(v, half + 1, F.size(v))).otherwise(F.slice(v, F.lit(1), half))
        # A digest gives 12 addends of 5 hexadecimal digits; longer values take more digests.
        sha = lambda b: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), b.cast("string"), F.array_join(other.cast("array<string>"), ",")), 256), 1, 60)
        digest = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / 12).cast("int")), sha), "")

        def one(d: Column):
            add = lambda i: F.conv(F.substring(d, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
            return F.transform(v, lambda x, i: F.when((i < half) == left, (x + add(i)) % F.get(radix, i)).otherwise(x).cast("int"))

        return _let(digest, one)

    def rounds(x: Column) -> Column:
        nonlocal half, radix
        half, radix = F.floor(F.size(x["v"]) / 2).cast("int"), x["s"]
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x["v"], step)

    half = radix = None
    return _let(F.struct(values.cast("array<int>").alias("v"), sizes.cast("array<int>").alias("s")), rounds)


def _digits(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\D", ""), "").cast("array<int>")


def _fill(text: Column, digits: Column) -> Column:
    """Put digits in the places of the digits of text, in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("t"))

    def put(s: Column, c: Column, d: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct((s["n"] + is_digit.cast("int")).alias("n"), F.concat(s["t"], F.when(is_digit, F.get(d, s["n"]).cast("string")).otherwise(c)).alias("t"))

    return _let(digits, lambda d: F.aggregate(F.split(text, ""), start, lambda s, c: put(s, c, d))["t"])


def _luhn(digits: Column, payload: bool = False) -> Column:
    """Luhn sum modulo 10; of a payload: as if a check digit 0 followed."""

    def total(v: Column) -> Column:
        turn = F.size(v) - (0 if payload else 1)
        twice = lambda x: x * 2 - F.when(x > 4, 9).otherwise(0)
        return F.aggregate(F.transform(v, lambda x, i: F.when((turn - i) % 2 == 1, twice(x)).otherwise(x)), F.lit(0), lambda a, x: a + x) % 10

    return _let(digits, total)


def _card(m: Column, key: str) -> Column:
    payload = _let(_digits(m), lambda d: F.slice(d, F.lit(1), F.size(d) - 1))
    new = feistel(payload, F.transform(payload, lambda _: F.lit(10)), key, "number")
    return _let(new, lambda n: _fill(m, F.concat(n, F.array((10 - _luhn(n, True)) % 10).cast("array<int>"))))


def _phone(m: Column, key: str) -> Column:
    """The ten national digits; area code and exchange keep starting with 0 or 1, or with 2 to 9. A leading 1 stays."""

    def of(digits: Column) -> Column:
        own = F.slice(digits, F.lit(-10), F.lit(10))
        low = F.transform(own, lambda x, i: F.when(i.isin(0, 3) & (x > 1), 2).otherwise(0))
        sizes = F.transform(own, lambda x, i: F.when(~i.isin(0, 3), 10).when(x > 1, 8).otherwise(2))
        new = F.zip_with(feistel(F.zip_with(own, low, lambda x, f: x - f), sizes, key, "phone"), low, lambda x, f: x + f)
        return _fill(m, F.concat(F.slice(digits, F.lit(1), F.size(digits) - 10), new))

    return _let(_digits(m), of)


def _ssn(m: Column, key: str) -> Column:
    part = F.split(m, "-").cast("array<int>")
    area = F.get(part, F.lit(0))
    new = feistel(F.array(area - 1 - (area > 666).cast("int"), F.get(part, F.lit(1)) - 1, F.get(part, F.lit(2)) - 1), _array(898, 99, 9999), key, "ssn")

    def text(n: Column) -> Column:
        area = F.get(n, F.lit(0)) + 1
        return F.format_string("%03d-%02d-%04d", area + (area >= 666).cast("int"), F.get(n, F.lit(1)) + 1, F.get(n, F.lit(2)) + 1)

    return _let(new, text)


def _ip(m: Column, key: str) -> Column:
    part = F.split(m, r"\.").cast("array<int>")
    return F.array_join(feistel(part, _array(256, 256, 256, 256), key, "ip").cast("array<string>"), ".")


def _day(m: Column) -> Column:
    """Days since DAY_BASE of a valid date in one of the formats, else null."""
    iso = (
        F.when(F.substring(m, 5, 1) == "-", m)
        .otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    )
    day = F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit(DAY_BASE).cast("date"))
    return F.when((day >= 0) & (day < DAYS), day)


def _date(m: Column, key: str) -> Column:
    """Walk the cycle until the permuted day lies in range again; 271 * 270 is 121 above, so one step mostly does."""

    def walk(s: Column, _: Column) -> Column:
        new = feistel(F.array(F.floor(s["d"] / DAY_RADIX[1]).cast("int"), (s["d"] % DAY_RADIX[1]).cast("int")), _array(*DAY_RADIX), key, "date")
        day = _let(new, lambda n: F.get(n, F.lit(0)) * DAY_RADIX[1] + F.get(n, F.lit(1)))
        return F.when(s["ok"], s).otherwise(_let(day, lambda d: F.struct(d.cast("int").alias("d"), (d < DAYS).alias("ok"))))

    # 121 days are outside, so a cycle is back inside after at most 122 steps.
    day = F.aggregate(F.sequence(F.lit(0), F.lit(DAY_RADIX[0] * DAY_RADIX[1] - DAYS)), F.struct(_day(m).cast("int").alias("d"), F.lit(False).alias("ok")), walk)["d"]
    date = F.date_add(F.lit(DAY_BASE).cast("date"), day)
    return (
        F.when(F.substring(m, 5, 1) == "-", F.date_format(date, "yyyy-MM-dd"))
        .when(F.substring(m, 3, 1) == "/", F.date_format(date, "dd/MM/yyyy"))
        .otherwise(F.date_format(date, "dd.MM.yyyy"))
    )


def _email(m: Column, key: str) -> Column:
    """Letters and digits of the local part, each within its class; the domain stays."""
    code = F.transform(F.split(F.substring_index(m, "@", 1), ""), lambda c: F.ascii(c))

    def of(code: Column) -> Column:
        base = F.transform(code, lambda c: F.when((c >= 97) & (c <= 122), 97).when((c >= 65) & (c <= 90), 65).when((c >= 48) & (c <= 57), 48).otherwise(c))
        sizes = F.transform(base, lambda b: F.when(b.isin(97, 65), 26).when(b == 48, 10).otherwise(1))
        return F.zip_with(feistel(F.zip_with(code, base, lambda c, b: c - b), sizes, key, "email"), base, lambda v, b: F.char(v + b))

    return F.concat(F.array_join(_let(code, of), ""), F.lit("@"), F.substring_index(m, "@", -1))


def _replace(m: Column, key: str) -> Column:
    """struct<kind, value> for one match; kind is null and the value unchanged if its check fails."""

    def is_(kind: str) -> Column:
        return m.rlike(f"^(?:{KINDS[kind]})$")

    makers = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    checks = {k: is_(k) for k in makers}
    checks["date"] = checks["date"] & _day(m).isNotNull()
    checks["card"] = checks["card"] & (_luhn(_digits(m)) == 0)
    kind = value = None
    for k, f in makers.items():
        kind = F.when(checks[k], k) if kind is None else kind.when(checks[k], k)
        value = F.when(checks[k], f(m, key)) if value is None else value.when(checks[k], f(m, key))
    return F.struct(kind.alias("kind"), value.otherwise(m).alias("value"))


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs with `text` rewritten and the counts n_email, n_ip, n_date, n_ssn, n_phone, n_card, n_replaced added.

    Admitted: card numbers of 13 to 19 digits with a right Luhn digit (it is computed anew), North American phone
    numbers, social security numbers, IPv4 addresses, dates from 1900 to 2099, and the local parts of e-mail addresses.
    Numbers that fail their check stay. A null text stays null with counts 0; repeated rows give equal rows; all other
    columns stay, but those of the added names are replaced. An empty key is an error; an empty table gives no rows.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text = F.col("text").cast("string")
    rows = docs.drop("_hits", *[f"n_{k}" for k in (*KINDS, "replaced")])
    hits = F.when(text.rlike("[0-9@]"), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _replace(m, key)))
    rows = rows.withColumn("_hits", hits)
    pieces = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.concat(F.transform("_hits", lambda h: h["value"]), F.array(F.lit(""))), lambda p, v: F.array(p, v))), "")
    count = lambda k: F.coalesce(F.size(F.filter("_hits", lambda h: h["kind"] == k)), F.lit(0)).cast("long")
    counts = {f"n_{k}": count(k) for k in KINDS}
    counts["n_replaced"] = F.coalesce(F.size(F.filter("_hits", lambda h: h["kind"].isNotNull())), F.lit(0)).cast("long")
    rows = rows.withColumns({**counts, "text": F.when(F.coalesce(F.size("_hits"), F.lit(0)) > 0, joined).otherwise(text)})
    return rows.drop("_hits")


def op7_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """All of documents: doc_id, the rewritten text and the counts; the key is that of KEY_SETTING."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymize(docs, spark.conf.get(KEY_SETTING, PUBLIC_KEY))
