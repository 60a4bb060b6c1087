"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything stays in SQL expressions. One pattern marks the candidates of a text; cutting at
the marks gives an array in which every second element is a candidate and its neighbours are
the text before and behind it. Features of a candidate are its length, character classes and
transitions between them, how much of it is made of dictionary words, signs of a path, and the
words next to it. A random forest (pyspark.ml) is trained on labelled findings and then written
out as one expression: every tree votes. No row is exploded, joined or shuffled.

Labelled findings are a table (before, candidate, behind, label). Where the caller has none,
``labelled_findings`` makes one from rules: keys and passwords in the forms that services
issue, and what is often mistaken for them (digests of commits, numbers, addresses, paths, long words,
placeholders).

Nulls: a null text has no candidates and stays null; a null doc_id is kept. Texts are scanned
whole; at most ``NEAR`` characters on either side of a candidate count as its neighbours.
Characters U+0001 and U+0002, used as marks, are read as blanks, and are blanks in a text from
which a secret was taken. Repeated rows are each reported. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions.vectors import let
from prismlake.runtime import columns, free_names

NEAR = 60
OPEN, CLOSE = "\u0001", "\u0002"
REDACTED = "[secret]"

#: Words that announce a secret.
KEYWORDS = "secret|token|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer"
#: Beginnings and forms of keys that services issue.
ISSUED = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+)?|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
#: Words next to strings that look like secrets and aren't.
HARMLESS = "commit|sha1|sha256|md5|hash|checksum|digest|uuid|guid|version|revision|build|example|sample|dummy|phone|card|order|invoice|serial|isbn|color|etag"
_TOKEN = r"[\w+/.~@-]"
#: An alternative begins with a character or place that is rare, so that most are passed at once.
_ASSIGNED = rf"""([:=](?<=(?i:{KEYWORDS})["']?\s{{0,2}}[:=])\s{{0,2}}["']?)([^\s"',;\u0001\u0002]{{6,}})"""
CANDIDATE = rf"""{_ASSIGNED}|(?=[Agxse-])({ISSUED})|(?<!{_TOKEN})((?={_TOKEN}{{12}})(?={_TOKEN}*[0-9]){_TOKEN}+)"""
#: A text without a digit and without any of these can't have a candidate; cheap to find.
HINTS = ["=", ":", "PRIVATE KEY", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk_", "eyJ"]

FEATURES = ["length", "digits", "upper", "lower", "others", "turns", "spoken", "distinct", "dictionary", "hex", "issued", "path", "asked", "near_keyword", "harmless", "placeholder", "goes_on", "number", "address"]


def _share(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, rf"[^{keep}]", "")) / F.greatest(F.length(text), F.lit(1))


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def dictionary(path: str, words: int = 400, least: int = 4) -> list[str]:
    """The first (most frequent) words of letters only that end in ``</w>`` in a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        known = sorted(json.load(f)["model"]["vocab"].items(), key=lambda item: item[1])
    whole = (w[:-4] for w, _ in known if w.endswith("</w>"))
    return [w for w in whole if len(w) >= least and w.isascii() and w.isalpha()][:words]


def features(before: Column, candidate: Column, behind: Column, words: list[str]) -> list[Column]:
    """In the order of ``FEATURES``; ``words``: the dictionary that a candidate may be covered by."""
    covered = "|".join(sorted(words, key=lambda w: (-len(w), w))) or r"\b\B"
    size = F.greatest(F.length(candidate), F.lit(1))
    runs = F.size(F.regexp_extract_all(candidate, F.lit(r"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+"), F.lit(0)))
    return [
        F.length(candidate).cast("double"),
        _share(candidate, "0-9"),
        _share(candidate, "A-Z"),
        _share(candidate, "a-z"),
        1 - _share(candidate, "0-9A-Za-z"),
        (runs - 1) / size,
        F.size(F.regexp_extract_all(F.lower(candidate), F.lit(r"[b-df-hj-np-tv-z][aeiouy]"), F.lit(0))) * 2 / size,
        F.size(F.array_distinct(F.split(candidate, ""))) / size,
        1 - F.length(F.regexp_replace(F.lower(candidate), covered, "")) / size,
        _flag(candidate.rlike("^[0-9a-fA-F]+$")),
        _flag(candidate.rlike(f"^(?:{ISSUED})$")),
        F.length(F.regexp_replace(candidate, r"[^/\\.@]", "")) / size,
        _flag(before.rlike(rf"""(?i)(?:{KEYWORDS})["']?\s{{0,2}}[:=]?\s{{0,2}}["']?$""")),
        _flag(before.rlike(f"(?i)(?:{KEYWORDS})")),
        _flag(before.rlike(rf"(?i)\b(?:{HARMLESS})\b\W{{0,4}}\w{{0,8}}\W{{0,4}}$")),
        _flag(candidate.rlike(r"(?i)x{4,}|\*{3,}|example|changeme|your[_-]|placeholder|dummy|\$\{|^<|insert|todo")),
        _flag(behind.rlike(r"^[./@:][A-Za-z0-9]")),
        _flag(candidate.rlike(r"^[+]?[0-9][0-9 .:()/-]*$")),
        _flag(candidate.rlike(r"@|://|^www\.|\.(?:com|org|net|html?|py|js|java|md|txt|json|png|jpg)\b")),
    ]


def parts(text: Column) -> Column:
    """The text cut at its candidates: elements 1, 3, 5, ... are candidates. Null if there can't
    be any."""
    marks = text.contains(OPEN) | text.contains(CLOSE)
    clean = F.when(marks, F.translate(text, OPEN + CLOSE, "  ")).otherwise(text)
    hint = reduce(lambda a, b: a | b, [text.contains(h) for h in HINTS]) | text.rlike("[0-9]")
    return F.when(hint, F.split(F.regexp_replace(clean, CANDIDATE, f"$1{OPEN}$2$3$4{CLOSE}"), f"[{OPEN}{CLOSE}]"))


def _tree(lines: list[tuple[int, str]], at: int, value) -> tuple[Column, int]:
    """The expression of the node in line ``at`` and the line behind it."""
    line = lines[at][1]
    if line.startswith("Predict"):
        return F.lit(float(line.split(":")[1])), at + 1
    _, number, bound = re.fullmatch(r"(If) \(feature (\d+) <= (\S+)\)", line).groups()
    low, at = _tree(lines, at + 1, value)
    high, at = _tree(lines, at + 1, value)  # after the line "Else"
    return F.when(value(int(number)) <= F.lit(float(bound)), low).otherwise(high), at


class Forest:
    """A trained forest as its description, one text per tree, and its dictionary."""

    def __init__(self, description: str, words: list[str]):
        self.words = words
        self.trees: list[list[tuple[int, str]]] = []
        for line in description.splitlines():
            text = line.strip()
            if text.startswith("Tree"):
                self.trees.append([])
            elif self.trees and text:
                self.trees[-1].append((len(line) - len(line.lstrip()), text))

    def score(self, value) -> Column:
        """Share of the trees that vote for a secret; ``value(k)`` is the k-th feature."""
        votes = [_tree(tree, 0, value)[0] for tree in self.trees]
        return reduce(lambda a, b: a + b, votes) / F.lit(float(len(votes)))


#: What the rules of ``labelled_findings`` make: secrets first, then what is mistaken for them.
FORMS = [
    "cloud key", "assigned hex", "assigned letters and digits", "assigned password", "hub token", "chat token", "map key", "payment key", "web token", "private key",
    "harmless hex", "bare hex", "card", "address", "mail", "link", "file", "word with digits", "placeholder", "assigned word", "uuid", "harmless letters and digits",
]


def labelled_findings(spark: SparkSession, rows: int = 4000, seed: int = 7) -> DataFrame:
    """(before, candidate, behind, label, form), made from rules; the same for the same arguments.

    ``form`` is the number of the rule, by which whole rules can be held out (``FORMS`` names them).
    """

    def text(alphabet: str, length: int | Column, key: str) -> Column:
        """A random string: one hash for each character."""
        n = F.lit(length) if isinstance(length, int) else length
        letters = F.lit(alphabet)
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(letters, F.pmod(F.xxhash64(F.col("id"), i, F.lit(f"{key}{seed}")), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))), "")

    def pick(options: list[str], key: str) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64(F.col("id"), F.lit(f"{key}{seed}")), F.lit(len(options))).cast("int") + 1)

    def number(low: int, high: int, key: str) -> Column:
        return (F.pmod(F.xxhash64(F.col("id"), F.lit(f"{key}{seed}")), F.lit(high - low + 1)) + low).cast("int")

    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hexa, every = digits + "abcdef", digits + upper + lower
    prose = F.concat(pick(["the ", "of ", "und ", "que ", "les ", "then ", "a ", "in\n", ""], "w1"), pick(["thing ", "ondre ", "stehen ", "hasta ", "deux ", "and, ", "it. "], "w2"))
    word = F.concat(*[pick(["the", "ing", "ou", "tion", "er", "sch", "eau", "an", "ado", "is", "ment", "re"], f"s{k}") for k in range(5)])
    assign = F.concat(prose, pick(["token", "password", "secret", "api_key", "API-KEY", "client_secret", "auth token", "passwd", "access_key"], "kw"), pick([" = ", "=", ": ", ' = "', "='", ':"'], "sep"))
    harmless = F.concat(prose, pick([*HARMLESS.split("|")], "hl"), pick([" ", ": ", "=", " is "], "hs"))
    behind = pick(["", " ", ". ", '" ', "'", " and then", ", "], "bh")
    yes = [
        (prose, F.concat(pick(["AKIA", "ASIA"], "p"), text(upper + digits, 16, "c")), behind),
        (assign, text(hexa, number(16, 64, "n"), "c"), behind),
        (assign, text(every, number(12, 48, "n"), "c"), behind),
        (assign, text(every + "!#%+-_", number(8, 20, "n"), "c"), behind),
        (prose, F.concat(pick(["ghp_", "gho_", "ghs_"], "p"), text(every, 36, "c")), behind),
        (prose, F.concat(pick(["xoxb-", "xoxp-"], "p"), text(digits, 11, "d"), F.lit("-"), text(every, 24, "c")), behind),
        (prose, F.concat(F.lit("AIza"), text(every, 35, "c")), behind),
        (prose, F.concat(F.lit("sk_live_"), text(every, 24, "c")), behind),
        (prose, F.concat(F.lit("eyJ"), text(every, 30, "c"), F.lit("."), text(every, 40, "d"), F.lit("."), text(every, 43, "e")), behind),
        (prose, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----"), text(every, 60, "c"), F.lit("-----END RSA PRIVATE KEY-----")), behind),
    ]
    no = [
        (harmless, text(hexa, pick(["32", "40", "64"], "n").cast("int"), "c"), behind),
        (prose, text(hexa, pick(["32", "40", "64"], "n").cast("int"), "c"), behind),
        (prose, text(digits, number(12, 19, "n"), "c"), behind),
        (prose, F.concat_ws(".", text("12", 2, "c"), text(digits, 3, "d"), text("12", 3, "e"), text(digits, 2, "f")), behind),
        (prose, F.concat(word, F.lit("."), number(1, 99, "n"), F.lit("@mail"), number(1, 9, "m"), F.lit(".example.com")), behind),
        (prose, F.concat(F.lit("https://"), word, F.lit(".org/"), number(1, 9999, "n"), F.lit("/"), word), behind),
        (prose, F.concat(F.lit("/home/"), word, F.lit("/file"), number(1, 99, "n"), F.lit(".txt")), behind),
        (prose, F.concat(word, number(1, 99, "n"), word), behind),
        (assign, pick(["changeme", "your_token_here", "xxxxxxxxxxxx", "${TOKEN}", "<insert-here>", "example123456", "********", "placeholder", "None,None", "required."], "ph"), behind),
        (assign, word, behind),
        (prose, F.concat_ws("-", text(hexa, 8, "c"), text(hexa, 4, "d"), text(hexa, 4, "e"), text(hexa, 4, "f"), text(hexa, 12, "g")), behind),
        (harmless, text(every, number(12, 24, "n"), "c"), behind),
    ]
    rules = [*[(r, 1.0) for r in yes], *[(r, 0.0) for r in no]]
    cases = F.array(*[F.struct(b.alias("before"), c.alias("candidate"), e.alias("behind"), F.lit(label).alias("label"), F.lit(k).alias("form")) for k, ((b, c, e), label) in enumerate(rules)])
    return spark.range(0, max(1, rows // len(rules)), 1, 1).select(F.explode(cases).alias("f")).select("f.*")


def train(findings: DataFrame, words: list[str], trees: int = 20, depth: int = 8, seed: int = 7) -> Forest:
    """A forest from findings (before, candidate, behind, label 0 or 1); null labels don't count.

    ``words``: see ``dictionary``.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    named = [c.alias(n) for n, c in zip(FEATURES, features(F.col("before"), F.col("candidate"), F.col("behind"), words))]
    table = findings.where("label is not null and candidate is not null").na.fill("", ["before", "behind"]).select(*named, F.col("label").cast("double").alias("label"))
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table).select("features", "label").cache()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, featureSubsetStrategy="sqrt").fit(data)
    data.unpersist()
    return Forest(model.toDebugString, words)


def _starts(parts: Column) -> Column:
    """For each element, the characters before it: sums of blocks of about the square root of
    their number, so that very many candidates in one text don't cost their square."""
    length = lambda some: F.aggregate(some, F.lit(0), lambda n, p: n + F.length(p))

    def with_width(b: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(parts), b), lambda i: length(F.slice(parts, i, b)))
        before = let(blocks, lambda x: F.transform(x, lambda _, k: F.aggregate(F.slice(x, F.lit(1), k), F.lit(0), lambda n, y: n + y)))
        return let(before, lambda x: F.transform(parts, lambda _, i: x[F.floor(i / b).cast("int")] + length(F.slice(parts, i - i % b + 1, i % b))))

    return let(F.ceil(F.sqrt(F.size(parts))).cast("int"), with_width)


def with_findings(docs: DataFrame, forest: Forest) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with working columns, and their names: ``parts`` of the text and ``found``, for every
    candidate in order (at, candidate, score). Each step is a column of its own, so that it is
    computed once."""
    names = dict(zip(("parts", "starts", "seen", "found"), free_names(docs, "parts", "starts", "seen", "found")))

    def describe(i: Column) -> Column:
        part = F.col(names["parts"])
        left, right = F.right(part[i - 1], F.lit(NEAR)), F.left(part[i + 1], F.lit(NEAR))
        return F.struct(F.col(names["starts"])[i].alias("at"), part[i].alias("candidate"), F.array(*[x.cast("double") for x in features(left, part[i], right, forest.words)]).alias("f"))

    some = F.size(names["parts"]) > 2
    out = docs.withColumn(names["parts"], parts(F.col("text")))
    out = out.withColumn(names["starts"], F.when(some, _starts(F.col(names["parts"]))))
    out = out.withColumn(names["seen"], F.when(some, F.transform(F.sequence(F.lit(1), F.size(names["parts"]) - 2, F.lit(2)), describe)))
    return out.withColumn(names["found"], F.transform(names["seen"], lambda c: F.struct(c["at"].alias("at"), c["candidate"].alias("candidate"), forest.score(lambda k: c["f"][k]).alias("score")))), names


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, at (characters before it), n_chars, digest, score, secret."""
    # outer: for an inner explode the optimizer adds a filter that computes the whole array again
    found, at = with_findings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), forest)
    found = found.select("doc_id", F.explode_outer(at["found"]).alias("c")).where("c is not null")
    return found.select(
        "doc_id",
        F.col("c.at").cast("long").alias("at"),
        F.length("c.candidate").cast("long").alias("n_chars"),
        F.sha2("c.candidate", 256).alias("candidate_sha256"),
        F.col("c.score").alias("score"),
        (F.col("c.score") >= threshold).alias("secret"),
    )


def redact(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; other columns and texts as they were."""
    found, at = with_findings(docs, forest)

    def clean(part: Column, i: Column) -> Column:
        secret = (i % 2 == 1) & (F.get(F.col(at["found"]), F.floor(i / 2).cast("int"))["score"] >= threshold)
        return F.when(secret, F.lit(REDACTED)).otherwise(part)

    any_ = F.coalesce(F.exists(at["found"], lambda c: c["score"] >= threshold), F.lit(False))
    text = F.when(any_, F.array_join(F.transform(at["parts"], clean), "")).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*columns(docs))
