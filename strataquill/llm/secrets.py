r"""Secret scans with DataFrame and SQL expressions only.

Candidates are whole private key blocks; quoted values that are assigned (after a word that names secrets also values with
blanks and values without quotes); passwords in URLs; and runs of at least 16 secret-like characters with a letter and a
digit. They have no greatest length. Left out are unquoted runs of letters only, and shorter ones, that no such word names.

A random forest tells secrets from look-alikes (checksums, paths, identifiers, placeholders, code). Its features: length of
the candidate, changes between character classes and their shares, share covered by words of code and of a public
vocabulary, marks of paths in and around it, and neighbouring words. It is trained on labelled findings, here those that
:func:`labelled_findings` makes by rule (``LABELLED`` of them, a bound that doesn't depend on the input), with Spark's own
trainer; the fitted trees are written out as nested CASE expressions, so that scanning is one projection over the
documents: no shuffle, no Python.

A text is split at its candidates; scores, places and redaction work on the pieces between them. Places are sums of
lengths, taken in about the square root of the number of candidates at a time.

Defined results: null and empty texts have no findings and stay as they are; equal rows are scanned each; an empty table
gives an empty result; other columns are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.llm.rows import quoted, unused

LABELLED, TREES, DEPTH, SEED = 3000, 20, 6, 17
WORDS = 3000
MASK = "[SECRET]"

#: Known beginnings of issued keys. (fixed values)
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "eyJ", "SG.", "npm_", "pypi-", "hf_", "dop_v1_", "ya29.")

#: Words near secrets, and words near look-alikes. (fixed values)
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "accesskey", "auth", "bearer", "credential", "private_key", "client_secret", "session_key")
HARMLESS_WORDS = ("commit", "sha1", "sha256", "sha512", "md5", "checksum", "digest", "hash", "integrity", "uuid", "guid", "revision", "etag", "build", "version", "href", "src", "class", "path", "file", "url", "id")
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "your", "placeholder", "xxxx", "test", "fake", "foobar", "redacted", "0000", "1234567", "****", "none", "null", "true", "false")

#: Common words of English and of code, for the dictionary coverage. (fixed values)
DICTIONARY = (
    "about", "access", "account", "action", "address", "after", "again", "also", "array", "back", "base", "before", "begin", "between", "block", "body",
    "buffer", "button", "cache", "call", "change", "char", "check", "child", "class", "clean", "client", "close", "code", "color", "column", "config",
    "content", "context", "control", "count", "create", "current", "data", "date", "default", "delete", "device", "double", "element", "error", "event", "factory",
    "field", "file", "filter", "first", "float", "format", "frame", "from", "function", "get", "global", "group", "handler", "have", "header", "height",
    "image", "import", "index", "info", "input", "instance", "item", "java", "key", "label", "language", "last", "layout", "length", "level", "lib",
    "line", "link", "linux", "list", "local", "main", "manager", "master", "message", "method", "model", "module", "name", "network", "node", "number",
    "object", "open", "option", "order", "output", "page", "param", "parent", "parse", "path", "point", "process", "project", "public", "query", "read",
    "record", "report", "request", "resource", "response", "result", "return", "root", "sample", "server", "service", "session", "setting", "size", "source", "start",
    "state", "static", "status", "stream", "string", "style", "system", "table", "target", "template", "test", "text", "that", "the", "this", "time",
    "title", "type", "update", "user", "util", "value", "version", "view", "width", "window", "with", "word", "write", "your",
)



def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


_QUOTE = r"[\x22\x27]"
#: Behind a word that names secrets and a sign.
_NAMED = rf"(?i:{_any(SECRET_WORDS)})[\w.-]{{0,24}}{_QUOTE}?\s{{0,3}}[:=]{{1,2}}>?\s{{0,3}}"

#: A URL with a password is no candidate as a whole, so that the password in it is one.
_NO_URL = r"(?![^\s\x22\x27]{0,200}://[^\s/@:\x22\x27]{1,64}:[^\s/@\x22\x27]{3,}@)"

_BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-[^-]++){0,12}-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_ASSIGNED = rf"(?<={_QUOTE})(?<=[:=]\s{{0,3}}{_QUOTE}){_NO_URL}[^\s\x22\x27<>]{{6,}}(?={_QUOTE})"
_IN_URL = r"(?<=:)(?<=://[^\s/@:]{1,64}:)[^\s/@]{3,}(?=@)"
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}"
_NAMED_QUOTED = rf"(?<={_QUOTE})(?<={_NAMED}{_QUOTE}){_NO_URL}[^\x22\x27\n]{{4,}}(?={_QUOTE})"
_NAMED_BARE = rf"(?<=[:=>\s])(?<={_NAMED}){_NO_URL}[^\s\x22\x27<>,;]{{6,}}"
#: Where no word that names secrets stands before a sign, the named forms can't occur, and a shorter pattern finds the same.
USUAL = "|".join((_BLOCK, _ASSIGNED, _IN_URL, _RUN))
CANDIDATE = "|".join((_BLOCK, _NAMED_QUOTED, _ASSIGNED, _IN_URL, _NAMED_BARE, _RUN))

_PRINTED = "".join(map(chr, range(0x21, 0x7F)))
FEATURES = ("length", "changes", "digits", "uppers", "signs", "blanks", "hex", "distinct", "dictionary", "vocabulary", "path_marks", "prefix", "secret_word", "harmless_word", "dashes", "assigned", "quoted", "path_around", "in_url", "uuid", "placeholder", "code")


def vocabulary_words(path: str, n: int = WORDS) -> tuple[str, ...]:
    """The ``n`` most frequent whole words, of at least four letters, of a public vocabulary file whose words end in </w>."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    whole = sorted((i, w[:-4]) for w, i in ids.items() if re.fullmatch(r"[a-z]{4,}</w>", w))
    return tuple(w for _, w in whole[:n])


def _features(v: str, left: str, right: str, words: tuple[str, ...] = ()) -> str:
    """SQL for the array of features of a candidate ``v`` between two texts."""
    n = f"greatest(char_length({v}), 1)"
    # Words stand for themselves or as part of a name like api_token.
    apart = lambda some: f"(?i)(?<![A-Za-z]){_any(some)}(?![A-Za-z])"
    flag = lambda x: f"cast({x} as double)"
    share = lambda pattern: f"cast(regexp_count({v}, r'{pattern}') as double) / {n}"
    parts = f"regexp_extract_all({v}, r'[A-Z]?[a-z]{{3,}}|[A-Z]{{4,}}', 0)"
    known = "0.0D" if not words else f"cast(aggregate(filter({parts}, w -> instr(' {' '.join(words)} ', concat(' ', lower(w), ' ')) > 0), 0, (s, w) -> s + char_length(w)) as double) / {n}"
    return "array(" + ", ".join((
        f"cast(char_length({v}) as double)",
        share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
        share("[0-9]"),
        share("[A-Z]"),
        share("[^A-Za-z0-9\\s]"),
        f"cast(regexp_count({v}, r'\\s') as double)",
        flag(f"{v} rlike r'^[0-9a-fA-F]+$'"),
        f"cast(size(filter(split(r'{_PRINTED.replace(chr(0x27), '')}', ''), x -> instr({v}, x) > 0)) as double) / least({n}, 93)",
        f"1 - cast(char_length(regexp_replace(lower({v}), r'{_any(DICTIONARY)}', '')) as double) / {n}",
        known,
        f"cast(regexp_count({v}, r'[/.]') as double)",
        flag(f"{v} rlike r'^{_any(PREFIXES)}|^-----BEGIN '"),
        flag(f"{left} rlike r'{apart(SECRET_WORDS)}[^A-Za-z]*$' or {left} rlike r'(?i){_any(SECRET_WORDS)}\\S{{0,24}}\\s{{0,3}}[:=]{{1,2}}>?\\s{{0,3}}\\S?$'"),
        flag(f"{left} rlike r'{apart(HARMLESS_WORDS)}[^A-Za-z]*$' or {right} rlike r'^[^A-Za-z]*{apart(HARMLESS_WORDS)}'"),
        f"cast(regexp_count({v}, r'[-_]') as double)",
        flag(f"{left} rlike r'[:=]>?\\s{{0,3}}[\\x22\\x27]?$'"),
        flag(f"{left} rlike r'[\\x22\\x27]$' and {right} rlike r'^[\\x22\\x27]'"),
        flag(f"{left} rlike r'(?:[/\\\\.~]|://\\S*)$' or {right} rlike r'^(?:[/\\\\]|\\.[a-z])'"),
        flag(f"{left} rlike r'://[^\\s/@:]+:$' and {right} rlike r'^@'"),
        flag(f"{v} rlike r'^[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$'"),
        flag(f"{v} rlike r'(?i){_any(PLACEHOLDERS)}'"),
        flag(f"{v} rlike r'[(){{}}\\[\\]]|^\\$|^%'"),
    )) + ")"


# Labelled findings -------------------------------------------------------------------------------------------------


def labelled_findings(n: int = LABELLED, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(candidate, text before, text after, 1 for a secret) by rules: issued formats, assigned random values, passphrases,
    key blocks and passwords in URLs against checksums, identifiers, paths, links, code, prose and placeholders."""
    rnd = random.Random(seed)
    low, up, num, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    some = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    pick = rnd.choice
    words = lambda k, glue: glue.join(pick(DICTIONARY) for _ in range(k))
    prose = lambda: " ".join(some(low, rnd.randint(2, 9)) for _ in range(rnd.randint(1, 5)))
    case = lambda s: pick((s, s, s.upper()))
    plain = lambda: (prose() + " ", " " + prose())
    digest = lambda: case(some(hexes, pick((32, 40, 40, 64))))

    def assigned(word: str, must: str = "") -> tuple[str, str]:
        quote = must or pick(('"', '"', "'", ""))
        named = f"{pick(('', 'my_', 'AWS_', 'db_'))}{case(word)}{pick(('', '', '_key', '_1'))}"
        named = pick((named, named, f'"{named}"')) if quote else named
        return f"{prose()} {named}{pick((' = ', '=', ': ', ' := ', ' => '))}{quote}", quote + pick(("\n", " ", ";", ", ", "}")) + prose()

    def secret() -> tuple[str, str, str]:
        kind = rnd.randrange(12)
        if kind < 3:  # issued, anywhere or assigned
            value = pick(PREFIXES) + some(low + up + num, rnd.randint(16, 40))
            return (value, *pick((lambda: (prose() + pick((" ", " = ", ": ")), pick((" ", "\n")) + prose()), lambda: assigned(pick(SECRET_WORDS))))())
        if kind == 3:
            lines = "\n".join(some(low + up + num + "+/", 64) for _ in range(pick((2, 3, 4, 12))))
            name = pick(("", "RSA ", "EC ", "OPENSSH ", "DSA "))
            return f"-----BEGIN {name}PRIVATE KEY-----\n{lines}\n-----END {name}PRIVATE KEY-----", prose() + "\n", "\n" + prose()
        if kind == 4:
            return pick((some(low + num, rnd.randint(4, 12)), some(low, 5) + some(num, 2) + pick("!$%&#"), some(low + up + num + "-_!", rnd.randint(8, 24)))), f"{prose()} {pick(('postgres', 'https', 'mysql', 'amqp', 'redis'))}://{pick(DICTIONARY)}:", f"@{pick(DICTIONARY)}.{pick(('com', 'org', 'local'))}/" + prose()
        if kind == 5:  # a passphrase
            return (" ".join(some(low, rnd.randint(3, 8)) for _ in range(rnd.randint(3, 6))), *assigned(pick(("password", "passwd", "passphrase", "secret")), '"'))
        if kind == 6:  # a short password
            return (pick((some(low, rnd.randint(4, 7)) + some(num, rnd.randint(1, 4)), some(low + up, 5) + some(num, 2) + pick("!$%&#@"), pick("PpSs") + pick("@a4") + some(low + num, 5))), *assigned(pick(("password", "passwd", "pwd"))))
        value = pick((
            lambda: case(some(hexes, pick((32, 40, 40, 48, 64)))),
            lambda: some(low + up + num, rnd.randint(18, 64)),
            lambda: some(low + up + num + "+/", pick((24, 40, 60, 88, 200))) + pick(("", "=", "==")),
            lambda: some(low + num, rnd.randint(18, 40)),
            lambda: some(low + up + num + "!#$%&*?", pick((10, 14, 20, 40, 300))),
        ))()
        return (value, *assigned(pick(SECRET_WORDS)))

    def harmless() -> tuple[str, str, str]:
        return pick((
            lambda: (digest(), *assigned(pick(HARMLESS_WORDS))),
            lambda: (digest(), f"{prose()} {pick(HARMLESS_WORDS)} ", " " + prose()),
            lambda: ("-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), *pick((plain, lambda: assigned(pick(("id", "uuid", "token")))))()),
            lambda: ("/".join((pick(("usr", "home", "src", "var")), words(1, ""), f"{words(1, '')}{some(num, 2)}", words(2, "_"))), f"{prose()} /", pick(("/", ".py ", ".txt ", "\n"))),
            lambda: (words(2, "-") + some(num, rnd.randint(2, 6)) + "-" + words(2, "-"), f"{prose()} https://{words(1, '')}.com/", pick(("/", ".html", " "))),
            lambda: ("".join(w.capitalize() for w in words(rnd.randint(3, 5), " ").split()) + some(num, rnd.randint(1, 3)), *plain()),
            lambda: (words(rnd.randint(3, 5), "_") + some(num, rnd.randint(1, 4)), *plain()),
            lambda: (pick(PLACEHOLDERS) + pick(("-", "_", "")) + words(rnd.randint(0, 2), pick("-_")) + some(num, rnd.randint(0, 3)), *assigned(pick(SECRET_WORDS))),
            lambda: (words(rnd.randint(1, 3), pick("_-.")), *assigned(pick(("name", "type", "class", "path", "title", "lang", "color", "mode")))),
            lambda: (some(low, rnd.randint(5, 14)) + some(num, 1) * rnd.randint(1, 4) + some(low, rnd.randint(3, 9)), *plain()),
            lambda: (digest(), *plain()),
            lambda: (pick(("$", "${", "os.environ[", "getenv(", "process.env.", "config.get(", "{{ ", "%(")) + case(words(rnd.randint(1, 3), "_")) + pick(("", ")", "}", "]", "()")), *assigned(pick(SECRET_WORDS))),
            lambda: (pick(("string", "String", "Optional", "required", "function", "undefined", "boolean", "nullable", "integer", "{string}", "Bearer", "Basic", "Digest")), *assigned(pick(SECRET_WORDS))),
            lambda: (words(rnd.randint(3, 8), " ") + pick(("", ".", "!")), *assigned(pick(("password", "token", "auth", "secret")) + pick(("_label", "_hint", "_title", "_help", "_error")), '"')),
            lambda: (pick(("sha512-", "sha256-", "sha1-", "")) + some(low + up + num + "+/", pick((43, 86, 27))) + pick(("=", "==", "")), *assigned(pick(("integrity", "checksum", "digest", "etag", "hash")), '"')),
            lambda: (some(num, 1) + "." + some(num, 2) + "." + some(num, 1) + pick(("", "-beta", "-rc1", "+build7")), *assigned(pick(("version", "revision", "build")))),
        ))()

    out = []
    for i in range(n):
        v, left, right = secret() if i % 2 else harmless()
        out.append((v, left[-80:], right[:40], i % 2))
    return out


# The forest --------------------------------------------------------------------------------------------------------


def _tree_sql(described: str, at: str) -> str:
    """A fitted tree's description as a CASE expression over the array of features ``at``."""
    lines = [x.strip() for x in described.splitlines()[1:] if x.strip()]
    place = 0

    def node() -> str:
        nonlocal place
        line = lines[place]
        place += 1
        if line.startswith("Predict:"):
            return "1" if float(line.split(":")[1]) > 0.5 else "0"
        k, bound = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        place += 1  # Else
        high = node()
        return low if low == high else f"(case when {at}[{k}] <= {float(bound)!r}D then {low} else {high} end)"

    return node()


_FORESTS: dict[tuple, str] = {}


def train(spark: SparkSession, labelled: list[tuple[str, str, str, int]] | None = None, trees: int = TREES, depth: int = DEPTH, words: tuple[str, ...] = ()) -> str:
    """SQL for the score, 0 to 1, over an array of features ``c.f``; kept per application."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = labelled if labelled is not None else labelled_findings()
    told = json.dumps([{"v": v, "l": left, "r": right, "y": float(y)} for v, left, right, y in rows])
    key = (spark.sparkContext.applicationId, hash(told), trees, depth, hash(words))
    if key not in _FORESTS:
        data = spark.range(1).select(F.explode(F.from_json(F.lit(told), "array<struct<v:string,l:string,r:string,y:double>>")).alias("x")).select("x.*")
        data = data.select(array_to_vector(F.expr(_features("v", "l", "r", words))).alias("features"), F.col("y").alias("label"))
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt").fit(data)
        votes = [_tree_sql(t.toDebugString, "c.f") for t in forest.trees]
        _FORESTS[key] = f"(({' + '.join(votes)}) / {float(trees)}D)"
    return _FORESTS[key]


# Scanning ----------------------------------------------------------------------------------------------------------


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _found(text: str, score: str, words: tuple[str, ...]) -> str:
    """SQL for struct(p: pieces between candidates, c: scored candidates) of a text."""
    pattern = f"case when {text} rlike r\"{_NAMED}\" then r\"{CANDIDATE}\" else r\"{USUAL}\" end"
    halves = f"named_struct('p', split({text}, {pattern}, -1), 'v', regexp_extract_all({text}, {pattern}, 0))"
    sum_of = lambda some: f"aggregate({some}, 0L, (t, y) -> t + y)"
    # A place is the sum of whole chunks of k lengths (s), then of the lengths in the last chunk.
    lengths = "transform(b.v, (x, i) -> cast(char_length(b.p[i]) + char_length(x) as bigint))"
    chunks = f"aggregate(sequence(0, cast((size(l) - 1) div k as int)), array(0L), (s, j) -> array_append(s, element_at(s, -1) + {sum_of('slice(l, j * k + 1, k)')}))"
    chunk = "cast(i div k as int)"
    start = f"s[{chunk}] + {sum_of(f'slice(l, {chunk} * k + 1, i % k)')} + char_length(b.p[i])"
    judged = _let("c", f"named_struct('f', {_features('v', 'right(b.p[i], 80)', 'left(b.p[i + 1], 40)', words)})", score)
    each = f"transform(b.v, (v, i) -> named_struct('i', i, 'v', v, 'start', {start}, 'score', {judged}))"
    placed = _let("l", lengths, _let("k", "greatest(1, cast(ceil(sqrt(size(l))) as int))", _let("s", chunks, each)))
    return _let("b", halves, f"named_struct('p', b.p, 'c', {placed})")


def scanned(docs: DataFrame, name: str, text_col: str = "text", labelled: list | None = None, words: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with a column ``name`` (p, c); null where a text has no candidate."""
    score = train(docs.sparkSession, labelled, words=words)
    text = "`" + text_col.replace("`", "``") + "`"
    return docs.withColumn(name, F.expr(f"case when {text} rlike r\"{USUAL}\" or ({text} rlike r\"{_NAMED}\" and {text} rlike r\"{CANDIDATE}\") then {_found(text, score, words)} end"))


def scan(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", words: tuple[str, ...] = ()) -> DataFrame:
    """One row per candidate: doc_id, place, start, length, value, score, secret."""
    rows = scanned(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), "found", words=words).where("found is not null")
    each = rows.select("doc_id", F.explode("found.c").alias("x"))
    return each.select(
        "doc_id", F.col("x.i").alias("place"), F.col("x.start").alias("start"), F.char_length("x.v").cast("long").alias("length"),
        F.col("x.v").alias("value"), F.col("x.score").alias("score"), (F.col("x.score") >= threshold).alias("secret"),
    )


def redacted(found: Column, threshold: float = 0.5, mask: str = MASK) -> Column:
    """The text of ``found`` (p, c) with its secrets masked."""
    parts = F.transform(found["c"], lambda x: F.concat(found["p"][x["i"]], F.when(x["score"] >= threshold, F.lit(mask)).otherwise(x["v"])))
    return F.concat(F.array_join(parts, ""), F.element_at(found["p"], -1))


def redact(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", chars_col: str = "n_chars", words: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the secrets of its texts masked (and ``chars_col``, if there is one, set to the new length)."""
    name = unused(docs, "found")
    rows, found, text, chars = scanned(docs, name, text_col, words=words), F.col(name), quoted(text_col), quoted(chars_col)
    hit = F.exists(found["c"], lambda x: x["score"] >= threshold)
    changed = rows.withColumn(text_col, F.when(hit, redacted(found, threshold)).otherwise(text))
    if chars_col in docs.columns:
        changed = changed.withColumn(chars_col, F.when(hit, F.char_length(text).cast(docs.schema[chars_col].dataType)).otherwise(chars))
    return changed.drop(name)
