"""Secret scan with a random forest that removes false positives (JVM expressions only).

Candidates are runs of at least sixteen characters ``A-Za-z0-9+/_-`` that hold a
digit or mix cases inside a word; tokens with a known key prefix; and whatever is
quoted or assigned behind a secret word, of any length and characters (unquoted
values end at white space, without closing quotes and ``,;.``). They may overlap; equal
spans count once. Each has the 48 characters before and the 24 after it. Every
candidate gets features from SQL functions: length, shares of character classes,
class transitions, distinct characters, hexadecimal and UUID form, known key
prefixes, the share covered by dictionary words (a list and the frequent words of
the corpus, of which a bounded number reaches the driver), path form, and the neighbouring
words. A random forest decides. It is trained on the driver from labelled
findings (a bounded table, by default ``labelled_findings``) whose features come
from the same expressions, and is compiled to CASE expressions, so scoring needs
no Python on the executors and no shuffle.

Positions are code points (end exclusive) in the whole text. One row per
candidate comes back, with its score.

Nulls and edge cases: a null or empty text has no candidates. A null id is kept.
Rows repeated whole give their candidates each. Other columns are ignored. An
empty table gives an empty table. Labelled findings of one class only give every
candidate that class.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import materialize

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
BEFORE, AFTER = 48, 24
SECRET = r"(?i)(secret|token|passw(or)?d|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?secret|signature|session)[\w.-]{0,16}[\"']?"
SECRET_WORD = SECRET + r"\s{0,3}(:=|=>|=|:|is|\s)\s{0,3}[\"'`]?(bearer\s+)?$"
#: What leads to a value: a secret word with an assignment, or with a space before a quotation; then the value, quoted or not.
LEAD = SECRET + r"(\s{0,3}(:=|=>|=|:|\bis\b)\s{0,3}((bearer|basic)\s{1,3})?|\s{1,3}(?=[\"'`])|(?<=bearer)\s{1,3})"
VALUE = r"^(?:([\"'`])(?!\1)([^\n]*?[^\n\\])\1|[\"'`]?([^\s\"'`]\S*))"
HASH_WORD = r"(?i)(commit|sha-?(1|256|512)?|md5|checksum|digest|etag|hash|integrity|revision|blob|tree|uuid|guid|trace|request[_-]?id|version|build)[\w.-]{0,12}[\"']?\s{0,3}[=:\s]\s{0,3}[\"'`]?$"
ASSIGNED = r"[=:]\s{0,3}[\"'`]?$"
QUOTED = r"[\"'`]$"
PATH_BEFORE = r"(https?://|/|\\|\.)[^\s\"']{0,40}$"
KEY_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk-|sk_live_|pk_live_|rk_live_|AIza|ya29|eyJ|npm_|dop_v1_|SG)"
#: What every lead, in lower case, and every known prefix holds one of.
LEAD_WORDS = "secret token passw pwd key auth bearer credential signature session".split()
PREFIX_WORDS = "AKIA ASIA ghp_ gho_ ghs_ glpat- xox sk- sk_live_ pk_live_ rk_live_ AIza ya29 eyJ npm_ dop_v1_ SG".split()
PREFIXED = "(?<![A-Za-z0-9])" + KEY_PREFIX[1:] + r"[A-Za-z0-9+/_.\-]+={0,2}"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Words of prose and of program names; a key hardly ever holds several of them. The frequent words of the corpus come on top.
WORDS = ("the and for that with this from have not are was tion ing ment able ness ally ible ent ous ive ure age ate "
         "get set user name data file path list item test time date page view main index image style script content config "
         "default value type class function return string number object array event handler request response service server client "
         "module package version update create delete select insert table column schema manager factory builder controller "
         "component template document window element button header footer background color width height margin padding").split()
NAMES = ["length", "digits", "uppers", "lowers", "marks", "transitions", "distinct", "hex", "uuid", "prefixed", "covered", "slashes", "secret_word", "hash_word", "assigned", "quoted", "path_before"]


def corpus_words(docs: DataFrame, *, text_col: str = "text", most: int = 500) -> list[str]:
    """The ``most`` most frequent words of four to twelve letters over all texts (ties: in alphabetical order), counted with map-side combine."""
    each = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+")).alias("word")).where("length(word) BETWEEN 4 AND 12")
    top = each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(most)
    return [r["word"] for r in top.collect()]


def features(value: Column, before: Column, after: Column, words: Sequence[str] = WORDS) -> list[Column]:
    n = F.char_length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda text, pattern: F.when(text.rlike(pattern), 1.0).otherwise(0.0)
    steps = F.regexp_count(value, F.lit("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"))
    plain = F.regexp_replace(F.lower(value), "|".join(sorted(set(words), key=lambda w: (-len(w), w))), "")
    columns = [
        n, share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^A-Za-z0-9]"), steps / n,
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)), flag(value, "^([0-9a-f]+|[0-9A-F]+)$"), flag(value, UUID),
        flag(value, KEY_PREFIX), 1 - F.char_length(plain) / n, share("/"), flag(before, SECRET_WORD), flag(before, HASH_WORD), flag(before, ASSIGNED),
        F.when(before.rlike(QUOTED) & after.rlike("^[\"'`]"), 1.0).otherwise(0.0), flag(before, PATH_BEFORE)]
    return [c.cast("double").alias(name) for name, c in zip(NAMES, columns, strict=True)]


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, value): the matches of a pattern that never matches nothing."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # a match starts after the gaps and matches before it
    return F.aggregate(
        F.arrays_zip(values.alias("value"), F.slice(gaps, 1, F.size(values)).alias("gap")),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,value:string>>").alias("found")),
        lambda acc, m: F.struct(
            (acc["end"] + F.char_length(m["gap"]) + F.char_length(m["value"])).alias("end"),
            F.concat(acc["found"], F.array(F.struct((acc["end"] + F.char_length(m["gap"])).alias("start"), m["value"].alias("value")))).alias("found")),
        lambda acc: acc["found"])


def _led(text: Column, lead: Column) -> Column:
    """(start, value) of the value behind a lead; an empty value where there is none."""
    at = lead["start"] + F.char_length(lead["value"])
    rest = F.substring(text, at + 1, F.char_length(text))
    quoted = F.regexp_extract(rest, VALUE, 2)
    bare = F.regexp_replace(F.regexp_extract(rest, VALUE, 3), "[\"'`,;.]+$", "")
    return F.struct((at + F.when(rest.rlike("^[\"'`]"), 1).otherwise(0)).alias("start"), F.when(quoted != "", quoted).otherwise(bare).alias("value"))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, start, value, before, after — one row per candidate."""
    text = F.col("_text")
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # plain containment is much cheaper than the patterns, and no lead or prefixed token is without one of these words
    low = F.lower(text)
    may_lead = functools.reduce(operator.or_, [F.contains(low, F.lit(w)) for w in LEAD_WORDS])
    may_prefix = functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in PREFIX_WORDS])
    found = found.withColumn("_lead", may_lead & text.rlike(LEAD)).withColumn("_prefix", may_prefix & text.rlike(PREFIXED))
    found = found.where(F.col("_lead") | F.col("_prefix") | text.rlike(CANDIDATE))
    none = F.array().cast("array<struct<start:int,value:string>>")
    runs = F.filter(_matches(text, CANDIDATE), lambda c: c["value"].rlike("[0-9]") | c["value"].rlike("[a-z][A-Z]"))
    prefixed = F.transform(_matches(text, PREFIXED), lambda c: F.struct(c["start"].alias("start"), F.regexp_replace(c["value"], "[.]+$", "").alias("value")))
    led = F.filter(F.transform(_matches(text, LEAD), lambda c: _led(text, c)), lambda c: c["value"] != "")
    prefixed, led = F.when(F.col("_prefix"), prefixed).otherwise(none), F.when(F.col("_lead"), led).otherwise(none)
    spans = found.select("doc_id", "_text", F.explode(F.array_distinct(F.concat(runs, prefixed, led))).alias("_span"))
    start, value = F.col("_span.start"), F.col("_span.value")
    return spans.select(
        "doc_id", start.cast("long").alias("start"), value.alias("value"),
        F.substring(text, F.greatest(start - BEFORE, F.lit(0)) + 1, F.least(start, F.lit(BEFORE))).alias("before"),
        F.substring(text, start + F.char_length(value) + 1, F.lit(AFTER)).alias("after"))


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """value, before, after, label: findings as reviewers see them, made by expressions from a row number.

    Each is written into a text and read back as a candidate, so that its context is one that scanning gives.
    """
    base = spark.range(rows).select("id", F.md5(F.concat(F.lit("a"), F.col("id"))).alias("a"), F.md5(F.concat(F.lit("b"), F.col("id"))).alias("b"),
                                    F.pmod(F.xxhash64("id"), F.lit(1000)).alias("r"), (F.col("id") % 24).alias("kind"))
    hex40, wide = F.concat("a", F.substring("b", 1, 8)), F.regexp_replace(F.base64(F.unhex(F.concat("a", "b"))), "=+$", "")
    url_safe = F.translate(wide, "+/", "-_")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("r") % len(xs) + 1).cast("int"))
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.conv(F.substring("a", k, 4), 16, 10).cast("int") % len(WORDS) + 1).cast("int"))
    keyed = pick("token = \"", "api_key=", "SECRET: ", "password=\"", "access_key = '", "Authorization: Bearer ", "client_secret: \"", "auth_token => '", " un token = \"", "de token: ")
    hashed = pick("commit ", "sha256: ", "md5=", "etag: \"", "checksum: ", "revision ", "integrity=\"", "digest = \"", "request_id=", "build: ")
    prose = pick("of the ", "see ", "and then ", "the ", "in ", ". ", "de la ", "und ")
    secret = pick("password=\"", "passwd: ", "pwd = '", "DB_PASSWORD=", "database_password = \"", "secret: '", "token=", "AWS_SECRET_ACCESS_KEY=", "password is \"", "GOOGLE_CLIENT_SECRET=", "auth: ", "session = ")
    letters = F.translate("a", "0123456789", "ghijklmnop")
    uuid = F.concat_ws("-", F.substring("a", 1, 8), F.substring("a", 9, 4), F.substring("a", 13, 4), F.substring("a", 17, 4), F.substring("b", 1, 12))
    camel = F.concat(word(1), F.initcap(word(5)), F.initcap(word(9)), F.initcap(word(13)), F.when(F.col("r") % 2 == 0, F.col("r").cast("string")).otherwise(""))
    kinds: list[tuple[Column, Column, int]] = [
        (hex40, keyed, 1), (F.col("a"), keyed, 1), (wide, keyed, 1), (F.concat(F.lit("AKIA"), F.upper(F.substring(url_safe, 1, 16))), pick("", "key ", "aws_access_key_id = ", "id: "), 1),
        (F.concat(pick("ghp_", "glpat-", "sk_live_", "npm_"), F.regexp_replace(F.substring(url_safe, 1, 36), "[-_]", "x")), pick("", "with ", "token ", "key="), 1),
        (F.concat("a", F.substring("b", 1, 16)), keyed, 1), (url_safe, keyed, 1),
        (hex40, hashed, 0), (F.concat("a", "b"), hashed, 0), (uuid, pick("id: ", "uuid=", "trace ", "the ", "user_id = \""), 0),
        (camel, pick("call ", "function ", ".", "the ", "= "), 0), (F.concat_ws("/", word(1), word(5), word(9), word(13)), pick("/", "https://example.com/", "./", "in "), 0),
        (F.concat_ws("_", word(1), word(5), word(9), F.col("r").cast("string")), pick("set ", "import ", "", "the "), 0),
        (F.concat(word(1), word(5), word(9), F.lit("20"), F.col("r").cast("string")), prose, 0), (F.lpad(F.conv(F.substring("a", 1, 12), 16, 10), 16, "4"), prose, 0),
        (F.concat_ws("-", word(1), word(5), word(9), F.col("r").cast("string")), pick("https://example.org/", "slug: ", "see ", "class=\""), 0),
        (F.concat(F.initcap(word(1)), pick("&", "!", "@", "$", ".", "#", ""), (F.col("r") % 89 + 1).cast("string"), pick("", "!", "x")), secret, 1),
        (F.translate(F.substring(F.col("a"), F.lit(1), (F.col("r") % 10 + 7).cast("int")), "02468ace", "T&o@$R!m"), secret, 1),
        (F.substring(wide, F.lit(1), (F.col("r") % 12 + 8).cast("int")), secret, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16))), pick("", "key ", "aws_access_key_id = ", "AWS_ACCESS_KEY_ID="), 1),
        (F.when(F.col("r") % 2 == 0, letters).otherwise(F.upper(letters)), secret, 1),
        (F.when(F.col("r") % 3 == 0, word(1)).otherwise(pick("true", "false", "null", "none", "required", "string", "expired", "invalid", "missing", "str", "None", "True", "the", "a")), secret, 0),
        (F.concat(pick("${", "$", "config.", "os.environ.", "<", "{{", "get_"), F.when(F.col("r") % 2 == 0, F.upper(word(1))).otherwise(word(5)), pick("}", "", "()", ">", "}}", "_name")), secret, 0),
        (F.when(F.col("r") % 2 == 0, (F.col("r") % 50).cast("string")).otherwise(F.concat(F.lit("sk-"), word(1))), F.when(F.col("r") % 2 == 0, secret).otherwise(prose), 0)]
    value, before, label = F.lit(""), F.lit(""), F.lit(0)
    for k, (v, p, y) in enumerate(kinds):
        here = F.col("kind") == k
        value, before, label = F.when(here, v).otherwise(value), F.when(here, p).otherwise(before), F.when(here, y).otherwise(label)
    lead = pick("", "see it there. ", "x = 1\n", "export ", "de la casa ", "{\"a\": 1, ")
    after = F.when(before.rlike(QUOTED), F.concat(F.right(before, F.lit(1)), F.lit(" "))).otherwise(pick(" ", "\n", ""))
    written = base.select(F.concat(lead, before).alias("left"), value.alias("value"), after.alias("after"), label.alias("label")).select(
        F.struct(F.char_length("left").alias("at"), "value", "label").alias("made"), F.concat("left", "value", "after").alias("text"))
    read = candidates(materialize(written, "findings"), "made", "text")  # written, so that the texts' expressions are not repeated
    return read.where((F.col("start") == F.col("doc_id.at")) & (F.col("value") == F.col("doc_id.value"))).select("value", "before", "after", F.col("doc_id.label").alias("label"))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int):
    """A tree: a leaf's share of positives, or (feature, cut, left, right)."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (0.0, None)
    for f in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (k >= least) & (len(y) - k >= least)
        if not ok.any():
            continue
        left, right = t[:-1] / k, (t[-1] - t[:-1]) / (len(y) - k)
        gain = np.where(ok, k * (left - y.mean()) ** 2 + (len(y) - k) * (right - y.mean()) ** 2, -1)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), (int(f), float((v[at] + v[at + 1]) / 2)))
    if best[1] is None:
        return float(y.mean())
    f, cut = best[1]
    low = x[:, f] <= cut
    return f, cut, _grow(x[low], y[low], rng, depth - 1, least), _grow(x[~low], y[~low], rng, depth - 1, least)


def fit_forest(findings: DataFrame, *, trees: int = 15, depth: int = 6, least: int = 8, seed: int = 5, most_rows: int = 20_000, words: Sequence[str] = WORDS) -> list:
    """The trees; at most ``most_rows`` labelled findings, those with the least hash, are used."""
    chosen = findings.orderBy(F.xxhash64("value", "before", "after"), "value").limit(most_rows)
    got = chosen.select(F.col("label").cast("double"), *features(F.col("value"), F.col("before"), F.col("after"), words)).collect()
    if not got:
        return [0.0]
    data = np.array([tuple(r) for r in got], dtype=np.float64)
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(data), len(data))
        forest.append(_grow(data[rows, 1:], data[rows, 0], rng, depth, least))
    return forest


def forest_score(forest: list) -> Column:
    """The mean of the trees as one expression over the feature columns."""
    def sql(node) -> str:
        if isinstance(node, float):
            return f"{node!r}D"
        f, cut, left, right = node
        return f"(CASE WHEN `{NAMES[f]}` <= {cut!r}D THEN {sql(left)} ELSE {sql(right)} END)"

    return F.expr("(" + " + ".join(map(sql, forest)) + f") / {len(forest)}D")


def scan_secrets(docs: DataFrame, forest: list, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, words: Sequence[str] = WORDS) -> DataFrame:
    """Per candidate: doc_id, start_char, end_char, value_sha256, score, is_secret."""
    found = candidates(docs, id_col, text_col)
    measured = found.select("doc_id", "start", "value", *features(F.col("value"), F.col("before"), F.col("after"), words))
    return measured.select(
        "doc_id", F.col("start").alias("start_char"), (F.col("start") + F.char_length("value")).alias("end_char"),
        F.sha2("value", 256).alias("value_sha256"), F.round(forest_score(forest), 9).alias("score")).withColumn("is_secret", F.col("score") >= threshold)
