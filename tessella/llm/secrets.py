"""Secret scans: candidates filtered by a random forest.  SQL functions only.

Candidates
    Words that hold a run of 16 or more of ``[A-Za-z0-9_+/=.-]`` with a digit
    in it, or a run of 8 or more after ``password=`` or the like.  So is any
    password in a link (``://name:password@``) and any value of 8 or more,
    with or without a digit, that has a key word as label in its word (``{"password":"hunter2secret"}``) or stands within two words
    after a key word with ``=`` or ``:`` (``password = "..."``, YAML).  A text's
    words are looked at only if the text holds one of these at all.  Every such
    run of a word is a candidate of its own, with the label before it; one
    without a label has the last label before it in the word (lists).

Model
    Features of a candidate: its length, the transitions between kinds of
    characters, shares of digits and capitals, the share that words of a
    dictionary cover, distinct characters, known prefixes, paths and links, the
    path of its document (``source``), and the neighbouring words.  A random
    forest (bootstrap rows, random features per node, Gini) is trained on
    labelled findings that ``labelled_findings`` writes: real forms of keys in
    the contexts where they are leaked, and what is mistaken for them (commit
    and checksum digests, identifiers, file names, links, placeholders).
    Training takes a bounded list on the driver; its features come from the
    same SQL as those of the corpus.  The forest is emitted as one SQL sum of
    CASE expressions, evaluated in a lambda inside each document's row: no
    shuffle, no Python, whatever a document holds.

Defined cases
    Null or empty text: no candidates.  Repeated rows: one result each.  Null
    doc_id and source stay null (null source: no path).  Empty table: no rows.
    Extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import random
import string
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_name

TREES, DEPTH, LEAF, SEED, CUT = 25, 6, 5, 5, 0.5

# Forms of keys, and words of contexts.
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk-|rk_live_|xoxb-|xoxp-|AIza|eyJ|npm_|SG\\."
SECRET_WORDS = "password|passwd|pwd|secret|token|api[_-]?key|apikey|auth|credential|private[ _-]?key|access[_-]?key|bearer"
BENIGN_WORDS = "sha1|sha256|sha|commit|checksum|hash|md5|digest|uuid|guid|id|version|isbn|order|build|revision|etag|image|file|example|sample|dummy|test"
DICTIONARY = (
    "the and for that with this from have not are was you all can had her one our out day get has him his how man new now old see two way who did its let put say she too use "
    "about after again their there these would which could other first water people number sound place where right large often together asked house world going want school important "
    "until form food keep children feet land side without boy once animal life enough took four head above kind began almost live page got earth need far hand high year mother light "
    "country father night picture being study second soon story since white ever paper hard near sentence better best across during today however sure knew example sample test dummy "
    "file image version user name data value index table error state group order build release report summary draft final photo screen shot config default local remote server client "
    "your here change placeholder none null true false"
).split()
RUN = "[A-Za-z0-9_+/=.-]"
PATTERN = rf"(?:(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=.-]*+[0-9]){RUN}{{16,}})|(?:(?i:password|passwd|pwd|secret|token|api_key|apikey)[=:][\"']?{RUN}{{8,}})"
# a label at the start of a run with what separates it from its value, a word's parts from label to label, and a part's runs
HEAD = r"""[+/=.-]*((?:[A-Za-z_][A-Za-z_.-]{1,63}|[A-Za-z_][A-Za-z0-9_.-]{1,14}))["'\\]*(?:=>|:=|[=:])["'\\\[({]*(?=[A-Za-z0-9_+/.!@#$%^*~-])"""
PARTS = rf"(?<!{RUN})(?={HEAD})"
KEY_RUN = rf"(?i:password|passwd|pwd|secret|token|api_key|apikey)[=:][\"']?{RUN}{{8"
RUNS = rf"""["'\\]*(?:^{HEAD}{RUN}+|{KEY_RUN},}}|{RUN}+?(?={KEY_RUN}}})|{RUN}+)["'\\]*"""
# a key word that = or : follows: anywhere in a text, just before a value (a short word may stand between), and with its value in one word
KEY_WORDS = SECRET_WORDS.replace("|auth|", "|auth(?!or(?!i))|")
SET = r"""["'\\\]]*[\x20\x09-\x0D]*(?:=>|:=|[=:])"""
KEYED = rf"(?i:{KEY_WORDS})[A-Za-z0-9_.-]{{0,24}}{SET}"
KEYED_BEFORE = rf"""{KEYED}["'\\\[({{|>]*(?: [^ ]{{1,7}})?$"""
VALUE = "[A-Za-z0-9_+/=.!@#$%^*~-]"
KEYED_WORD = rf"""(?i:{KEY_WORDS})[A-Za-z0-9_.-]{{0,24}}["'\\]*(?:=>|:=|[=:])["'\\\[({{]*{VALUE}{{8,}}"""
WHOLE = rf"(?:{VALUE}+?(?=[!@#$%^*~]{HEAD})|{VALUE}+)"
KEYED_RUNS = rf"""["'\\]*(?:^{HEAD}{WHOLE}|{WHOLE})["'\\]*"""

# a password in a link: name, colon, password, at sign
USERINFO = r"://[^\s/@:]*:([^\s/@]{6,})@"

FEATURES = {
    "length": "double(length(c.core))",
    "transitions": "double(length(c.shape) - 1)",
    "transition_share": "(length(c.shape) - 1) / greatest(length(c.core), 1)",
    "digits": "length(regexp_replace(c.core, '[^0-9]', '')) / greatest(length(c.core), 1)",
    "capitals": "length(regexp_replace(c.core, '[^A-Z]', '')) / greatest(length(c.core), 1)",
    "dictionary": f"1.0D - length(regexp_replace(lower(c.core), '{'|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))}', '')) / greatest(length(c.core), 1)",
    "distinct": "size(array_distinct(split(c.core, ''))) / greatest(length(c.core), 1)",
    "hex": "if(c.core rlike '^[0-9a-f]+$' or c.core rlike '^[0-9A-F]+$', 1.0D, 0.0D)",
    "numeric": "if(c.core rlike '^[0-9.+-]+$', 1.0D, 0.0D)",
    "prefix": f"if(c.core rlike '^(?:{PREFIXES})', 1.0D, 0.0D)",
    "separators": "double(length(regexp_replace(c.core, '[^_.-]', '')))",
    "path": r"if(c.core rlike '/.*/|^[a-z]+:|[.](?:png|jpe?g|gif|html?|js|css|txt|pdf|zip|py)$' or c.word rlike '://|^www[.]', 1.0D, 0.0D)",
    "source": "if(c.source rlike '(?i)test|example|sample|doc|fixture', 1.0D, 0.0D)",
    "secret_word": f"if(concat(c.before, ' ', c.label) rlike '(?i)(?:{SECRET_WORDS})', 1.0D, 0.0D)",
    "benign_word": rf"if(concat(c.before, ' ', c.label, ' ', c.after) rlike '(?i)\\b(?:{BENIGN_WORDS})\\b', 1.0D, 0.0D)",
    "assigned": "if(c.label <> '' or c.before rlike '[=:]\\\\s*$', 1.0D, 0.0D)",
    "quoted": "if(c.word rlike '[\"]', 1.0D, 0.0D)",
}


def with_candidates(df: DataFrame, text: str, source: str, name: str) -> DataFrame:
    """df with the array of candidates (null: none)."""
    # the words are held once and searched in a lambda over a list of one
    pattern, keyed_word, long = F.lit(PATTERN), F.lit(KEYED_WORD), F.lit(f"{VALUE}{{8}}")
    w_of = lambda h: F.flatten(F.filter(F.transform(h["ws"], lambda w, i: F.when(F.rlike(w, pattern) | F.rlike(w, F.lit(USERINFO)) | (h["keyed"] & F.rlike(w, long) & (F.rlike(w, keyed_word) | keyed_before(h["ws"], w, i))), around(h, w, i))), lambda y: y.isNotNull()))

    def words_before(ws, i, n):
        low = F.greatest(i - n + 1, F.lit(1))
        return F.array_join(F.slice(ws, low, i - low + 1), " ")

    def keyed_before(ws, w, i):
        return F.rlike(F.concat(words_before(ws, i, 2), F.regexp_extract(w, "^[=:>]+", 0)), F.lit(KEYED_BEFORE))

    def around(h, w, i):
        """Candidates of one word."""
        near = F.struct(F.concat(words_before(h["ws"], i, 3), F.regexp_extract(w, "^[=:>]+", 0)).alias("before"), F.array_join(F.slice(h["ws"], i + 2, F.lit(2)), " ").alias("after"), (h["keyed"] & keyed_before(h["ws"], w, i)).alias("keyed"))

        def own(n, part, last):
            keyed = n["keyed"] | F.rlike(last, F.lit(f"(?i:{KEY_WORDS})"))
            runs = F.regexp_extract_all(part, F.when(keyed, F.lit(KEYED_RUNS)).otherwise(F.lit(RUNS)), 0)
            return F.transform(F.filter(runs, lambda x: F.rlike(x, pattern) | (keyed & F.rlike(F.regexp_replace(x, f"^[\"'\\\\]*{HEAD}", ""), long))), lambda x: F.struct(x.alias("x"), last.alias("last")))

        def of(n):
            found = F.flatten(F.transform(F.split(w, PARTS), lambda part: own(n, part, F.regexp_extract(part, f"^{HEAD}", 1))))
            inside = F.regexp_extract_all(w, F.lit(USERINFO), 1)
            # what is found in a link already isn't taken twice
            plain = F.filter(found, lambda r: ~F.exists(inside, lambda x: F.contains(r["x"], x) | F.contains(x, r["x"])))
            return F.concat(F.transform(plain, lambda r: candidate(i, n, r["x"], r["last"])), F.transform(inside, lambda x: candidate(i, n, x, F.lit("password"))))

        return F.flatten(F.transform(F.array(near), of))

    def candidate(i, near, x, last):
        head = rf"""^["'\\]*{HEAD}"""
        core = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, head, ""), "^[^A-Za-z0-9/+]+", ""), r"[^A-Za-z0-9_+/=-]+$", "")
        label = F.regexp_extract(x, head, 1)
        shape = core
        for kind, sign in (("[^A-Za-z0-9]+", "_"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")):
            shape = F.regexp_replace(shape, kind, sign)
        return F.struct(i.alias("at"), x.alias("word"), core.alias("core"), F.when(label != "", label).otherwise(last).alias("label"), near["before"].alias("before"), near["after"].alias("after"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), shape.alias("shape"))

    keyed = F.rlike(F.col(text), F.lit(KEYED))
    held = F.array(F.struct(F.split(F.col(text), r"[\x20\x09-\x0D]+").alias("ws"), keyed.alias("keyed")))
    return df.withColumn(name, F.when(F.rlike(F.col(text), pattern) | keyed | F.rlike(F.col(text), F.lit(USERINFO)), F.flatten(F.transform(held, w_of))))


def features_sql(name: str) -> str:
    own = ", ".join(f"coalesce({sql}, 0.0D) as {k}" for k, sql in FEATURES.items())
    return f"transform({name}, c -> struct(c.at as at, c.core as core, c.label as label, {own}))"


# Random forest ------------------------------------------------------------


def grow_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH, leaf: int = LEAF):
    """(share of positives) or (feature, threshold, low, high)."""
    if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(v))
        ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(v) - n >= leaf)
        if not ok.any():
            continue
        p = np.cumsum(t)[:-1]
        q = t.sum() - p
        m = len(v) - n
        gini = np.where(ok, p * (n - p) / n + q * (m - q) / m, np.inf)
        at = int(np.argmin(gini))
        if best is None or gini[at] < best[0]:
            best = (gini[at], int(f), float((v[at] + v[at + 1]) / 2))
    if best is None:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow_tree(x[low], y[low], rng, depth - 1, leaf), grow_tree(x[~low], y[~low], rng, depth - 1, leaf))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> list:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow_tree(x[rows], y[rows], rng))
    return out


def tree_sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    f, threshold, low, high = tree
    return f"CASE WHEN f.{list(FEATURES)[f]} <= {threshold!r}D THEN {tree_sql(low)} ELSE {tree_sql(high)} END"


def tree_value(tree, row) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def forest_sql(forest: list) -> str:
    return "(" + " + ".join(tree_sql(t) for t in forest) + f") / {float(len(forest))!r}D"


# Labelled findings --------------------------------------------------------


def labelled_findings(n: int = 3000, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(text, source, label): one finding in each text, 1 if it is a secret."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexes, low, up, digits, alnum = "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase, string.digits, string.ascii_letters + string.digits
    words = lambda k: " ".join(pick(low, rng.randint(2, 8)) for _ in range(k))
    secret = lambda: rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth_token", "secret_key", "access_token"])
    benign = lambda: rng.choice(["sha256", "commit", "checksum", "md5", "build", "revision", "etag", "uuid", "id", "order", "isbn"])
    value = lambda: rng.choice([pick(hexes, rng.choice([18, 24, 32, 40])), pick(alnum, rng.randint(16, 40)), pick(alnum + "_-", rng.randint(20, 44))]) + rng.choice(digits)
    short = lambda: rng.choice([pick(low, rng.randint(4, 7)) + pick(digits, rng.randint(1, 4)) + pick(low, rng.randint(3, 7)), rng.choice(DICTIONARY) + pick(digits, rng.randint(1, 3)) + pick(alnum, 6), pick(alnum + "!@$%", rng.randint(10, 15)) + rng.choice(digits), pick(low, rng.randint(16, 24)), pick(low, rng.randint(16, 24))])
    prose = lambda: rng.choice([pick(low, rng.randint(8, 13)), pick(low, rng.randint(8, 13)).capitalize(), "".join(rng.choice(DICTIONARY) for _ in range(2)) + "ation"])
    setting = lambda v, key=secret: rng.choice(["{0}={1}", '{0}="{1}"', '{0} = "{1}"', "{0}: {1}", '{{"{0}":"{1}"}}', '"{0}": "{1}"', "{0} := '{1}'", '{0} ="{1}"']).format(key(), v)
    real = [
        lambda: setting(pick(low, rng.randint(15, 26))),
        lambda: setting(pick(low, rng.randint(15, 26))),
        lambda: setting("".join(rng.choice(DICTIONARY) for _ in range(rng.randint(4, 6)))),
        lambda: setting(short()),
        lambda: setting(short()),
        lambda: setting(short()),
        lambda: setting(value()),
        lambda: rng.choice(["AKIA", "ASIA"]) + pick(up + digits, 15) + rng.choice(digits),
        lambda: f"{secret()}={value()}",
        lambda: f'{secret()} = "{value()}"',
        lambda: f"{secret()}: {value()}",
        lambda: "ghp_" + pick(alnum, 35) + rng.choice(digits),
        lambda: "sk_live_" + pick(alnum, 23) + rng.choice(digits),
        lambda: f"xoxb-{pick(digits, 11)}-{pick(alnum, 24)}",
        lambda: f"bearer eyJ{pick(alnum, 40)}.eyJ{pick(alnum, 60)}1",
        lambda: "AIza" + pick(alnum, 34) + rng.choice(digits),
        lambda: f"{rng.choice(['postgres', 'mysql', 'mongodb', 'https', 'amqp', 'ftp'])}://{pick(low, rng.randint(3, 8))}:{rng.choice([short, value])()}@{pick(low, rng.randint(2, 9))}{rng.choice(['', '.example.com', ':5432', '.internal/db'])}",
        lambda: f"-----BEGIN {rng.choice(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY----- {pick(alnum + '+/', 63)}{rng.choice(digits)}",
    ]
    fake = [
        lambda: setting(pick(hexes, rng.choice([32, 40, 64])) + rng.choice(digits), benign),
        lambda: setting(pick(hexes, rng.choice([32, 40, 64])) + rng.choice(digits), benign),
        lambda: f"{secret()}: {prose()}",
        lambda: f"the {secret()}: {rng.choice(DICTIONARY)[:7]} {prose()}",
        lambda: setting(prose()),
        lambda: setting(rng.choice(["changeme", "undefined", "required", "********", "xxxxxxxx", "placeholder", "your-password", "your_token_here", "password", "example-secret"])),
        lambda: f"{secret()} = {rng.choice(['self', 'config', 'os.environ', 'request.form', 'settings'])}.{rng.choice(['get', 'client', 'user', 'default'])}_{secret()}",
        lambda: f"{benign()} {pick(hexes, rng.choice([32, 40, 64]))}1",
        lambda: f"{rng.choice(['postgres', 'mysql', 'https', 'redis'])}://{rng.choice(['user', 'username', 'name'])}:{rng.choice(['password', 'changeme', '********', 'xxxxxxxx', 'your-password', 'example'])}@{pick(low, 6)}.example.com",
        lambda: f"-----BEGIN {rng.choice(['CERTIFICATE', 'PUBLIC KEY', 'RSA PUBLIC KEY'])}----- {pick(alnum + '+/', 63)}{rng.choice(digits)}",
        lambda: f"{benign()}: {pick(hexes, 40)}2",
        lambda: f"{benign()}={pick(hexes, 32)}3",
        lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)) + "1",
        lambda: pick(digits, rng.randint(16, 19)),
        lambda: "https://" + pick(low, 8) + ".example.com/" + "/".join(pick(low + digits, 8) for _ in range(3)) + "1",
        lambda: "/usr/" + "/".join(pick(low, 6) for _ in range(3)) + f"{rng.randint(1, 99)}.png",
        lambda: "_".join(rng.choice(DICTIONARY) for _ in range(rng.randint(3, 5))) + str(rng.randint(1, 2024)),
        lambda: "".join(rng.choice(DICTIONARY).capitalize() for _ in range(rng.randint(3, 6))) + str(rng.randint(1, 99)),
        lambda: f"{secret()}={rng.choice(['your', 'example', 'sample', 'dummy', 'placeholder'])}_{rng.choice(DICTIONARY)}_{secret()}_{rng.choice(['here', 'test', 'value'])}{rng.randint(1, 99)}",
        lambda: f"{secret()}={rng.choice('xX*01a') * rng.randint(16, 24)}1",
        lambda: pick(low, rng.randint(10, 20)) + "-" + pick(low, rng.randint(4, 12)) + str(rng.randint(1, 9)),
        lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}-{pick(low, 8)}.{pick(digits, 8)}",
        lambda: f"+{pick(digits, 2)}-{pick(digits, 3)}-{pick(digits, 4)}-{pick(digits, 5)}",
        lambda: pick(low, 6) + "." + pick(low, 7) + "1" + pick(digits, 2) + "@" + pick(low, 8) + ".example.org",
    ]
    out = []
    for i in range(n):
        y = i % 2
        form = rng.choice(real if y else fake)()
        out.append((f"{words(rng.randint(0, 6))} {form} {words(rng.randint(0, 5))}", rng.choice(["src1", "web", "books", "app/config", "notes"] + ([] if y else ["test/fixtures", "docs/example"])), y))
    return out


def candidate_rows(df: DataFrame, text: str, source: str) -> DataFrame:
    """df with cands, an array of feature structs."""
    held = with_candidates(df, text, source, "cands")
    return held.withColumn("cands", F.expr(features_sql("cands")))


_FORESTS: dict[tuple[int, int], str] = {}


def forest_for(spark: SparkSession, n: int = 3000, seed: int = SEED) -> str:
    """SQL of the forest trained on labelled_findings(n, seed)."""
    if (n, seed) not in _FORESTS:
        x, y = training_rows(spark, n, seed)
        _FORESTS[n, seed] = forest_sql(grow_forest(x, y))
    return _FORESTS[n, seed]


def training_rows(spark: SparkSession, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled findings, by the corpus's own SQL."""
    labelled = spark.createDataFrame(labelled_findings(n, seed), "text string, source string, y int")
    rows = candidate_rows(labelled, "text", "source").select("y", F.explode("cands").alias("f")).select("y", *[F.col(f"f.{k}").alias(k) for k in FEATURES], "f.core").orderBy("core", "y").collect()
    return np.array([[r[k] for k in FEATURES] for r in rows]), np.array([r["y"] for r in rows])


SCORED = "transform({c}, f -> struct(f.at as word_index, f.core as candidate, f.label as label, {score} as score))"


def findings(df: DataFrame, name: str, text: str = "text", source: str = "source", n: int = 3000, seed: int = SEED) -> DataFrame:
    """df with an array column name: word_index, candidate, label, score of every candidate."""
    held = free_name(df, "cands")
    out = with_candidates(df, text, source, held)
    out = out.withColumn(held, F.expr(features_sql(f"`{held}`")))
    scored = SCORED.format(c=f"`{held}`", score=forest_for(df.sparkSession, n, seed))
    return out.withColumn(name, F.coalesce(F.expr(scored), F.array().cast("array<struct<word_index: int, candidate: string, label: string, score: double>>"))).drop(held)


def scan(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, n_candidates, secrets (the findings with a score of cut or more) of each row of docs."""
    found = findings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"), "found")
    return found.select("doc_id", F.size("found").cast("long").alias("n_candidates"), F.filter("found", lambda f: f["score"] >= cut).alias("secrets"))


def redact(docs: DataFrame, cut: float = CUT, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark."""
    name = free_name(docs, "found")
    found = findings(docs, name)
    # longest first: a secret may be a part of another
    secret = F.array_distinct(F.transform(F.filter(F.col(name), lambda f: f["score"] >= cut), lambda f: f["candidate"]))
    ordered = F.reverse(F.array_sort(F.transform(secret, lambda c: F.struct(F.length(c).alias("n"), c.alias("candidate")))))
    clean = F.aggregate(ordered, F.col("text"), lambda text, f: F.replace(text, f["candidate"], F.lit(mark)))
    return found.withColumn("text", clean).select(*[F.col(f"`{c}`") for c in docs.columns])
