"""A stored search index: postings by version and first character, lengths beside them.

A posting is a row: a token with case and diacritics folded, as it is written where that
differs, its column, all its positions there, and the lengths of all columns of its row, so
that a search needs no other table. The occurrences of a token in a text are brought
together where the text lies, and each task writes its own postings, so that a build
shuffles no postings. The tokens are counted first and the texts dealt out to tasks of a
bounded number of them, those of several versions by version, so that a task's postings
are sorted in memory. Postings lie in a folder for each version and first character, in files sorted by token, so
that a search reads the few folders and row groups that its terms can be in. Each row also has a marker in the folder ``ROWS``; a version's number of
rows and total lengths are summed up from them once and kept in the registry.

Single words are counted by row, in each file before the exchange. A phrase is found by where
it would begin: an occurrence of its j-th word at position p speaks for p - j, and a beginning
that all words speak for is a hit. One exchange by row does for all phrases of a query. Terms
are found in one column each.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Sequence
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.operators.search import B, K1, LEAST_IDF
from verspan.store.parts import PartStore

TOKEN = r"[\p{L}\p{N}]+"
#: Tokens of a task of a build, whose postings it sorts in some 200 bytes each; a task of fewer than the least isn't worth its files.
TOKENS_AT_ONCE, LEAST_TOKENS = 2_000_000, 100_000
#: The folder of the markers; that of tokens that don't begin with a letter a-z or a digit.
ROWS, OTHER = "rows", "other"


@cache
def accents() -> tuple[str, str]:
    """Characters whose decomposition is one character and marks, and those characters, by Unicode's tables."""
    pairs = []
    for c in map(chr, range(0xC0, sys.maxunicode + 1)):
        if unicodedata.category(c)[0] == "L" and unicodedata.decomposition(c) and "<" not in unicodedata.decomposition(c):
            plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
            if len(plain) == 1 and plain != c:
                pairs.append((c, plain))
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


def folded(text: Column) -> Column:
    """Lower case without diacritics: composed letters by a table, marks that stand alone are left out."""
    return F.lower(F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), *accents()))


def fold(word: str) -> str:
    return word.translate(str.maketrans(*accents())).lower()


def words_of(phrase: str) -> list[str]:
    """The tokens of a query's phrase, as written."""
    return re.findall(r"[^\W_]+", "".join(c for c in phrase if unicodedata.category(c) != "Mn"))


def _pieces(text: Column) -> Column:
    """(written, token) of each token: folding maps letters to letters, so that both spellings have the same tokens."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Mn}+", "")
    tokens = lambda t: F.regexp_extract_all(t, F.lit(TOKEN), 0)
    return F.arrays_zip(tokens(F.lower(plain)).alias("written"), tokens(F.lower(F.translate(plain, *accents()))).alias("token"))


def _lead(token: Column) -> Column:
    return F.when(token.rlike("^[a-z0-9]"), F.substring(token, 1, 1)).otherwise(OTHER)


class SearchIndex:
    """Postings of rows (version, row, texts); row_type: the type of a row's identity."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], row_type: str = "bigint"):
        self.spark, self.columns = spark, list(columns)
        schema = f"version string, lead string, token string, written string, row {row_type}, col int, pos array<int>, lens array<int>"
        self.store = PartStore(spark, f"{path.rstrip('/')}/postings", schema, "version", ["lead"], ["token", "row", "col"])

    def build(self, rows: DataFrame, versions: Iterable[str], force: bool = False) -> list[str]:
        """Indexes the versions that have no index yet, of rows with ``version``, ``row`` and the text columns."""
        todo = self.store.missing(versions, force)
        if not todo:
            return []
        rows = self._dealt(rows.where(F.col("version").isin(todo)).select("version", "row", *self.columns), len(todo))
        pieces = rows.select("version", "row", *[_pieces(F.col(c)).alias(f"_{i}") for i, c in enumerate(self.columns)])
        pieces = pieces.withColumn("lens", F.array(*[F.size(f"_{i}") for i in range(len(self.columns))]))
        key = lambda token, written, col: F.struct(token.alias("token"), written.alias("written"), col.cast("int").alias("col"))
        entry = lambda i: F.transform(f"_{i}", lambda w, p: F.struct(key(w["token"], F.nullif(w["written"], w["token"]), F.lit(i)).alias("key"), p.alias("pos")))
        # the occurrences of a row in order: a posting begins where the key changes
        sorted_ = pieces.select("version", "row", "lens", F.sort_array(F.concat(*[entry(i) for i in range(len(self.columns))])).alias("s"))
        changes = lambda e, k: F.when((k == 0) | ~F.get("s", k - 1)["key"].eqNullSafe(e["key"]), k)
        begun = sorted_.withColumn("b", F.array_compact(F.transform("s", changes)))
        until = lambda j: F.coalesce(F.get("b", j + 1), F.size("s"))
        posting = lambda k, j: F.struct(F.get("s", k)["key"].alias("key"), F.transform(F.slice("s", k + 1, until(j) - k), lambda e: e["pos"]).alias("pos"))
        marker = F.array(F.struct(key(F.lit(""), F.lit(None).cast("string"), F.lit(-1)).alias("key"), F.array().cast("array<int>").alias("pos")))
        each = begun.select("version", "row", "lens", F.explode(F.concat(marker, F.transform("b", posting))).alias("e")).select("version", "row", "lens", "e.key.*", "e.pos")
        lead = F.when(F.col("col") < 0, ROWS).otherwise(_lead(F.col("token")))
        out = each.select("version", lead.alias("lead"), "token", "written", "row", "col", "pos", "lens")
        self.store.write(out, todo, lie=True)
        self._count(todo)
        return todo

    def _dealt(self, rows: DataFrame, versions: int) -> DataFrame:
        """The texts, not their postings, in tasks of a bounded number of tokens; a task has few versions, so that it writes few files."""
        tokens = reduce(lambda x, y: x + y, [F.coalesce(F.regexp_count(F.col(c), F.lit(TOKEN)), F.lit(0)) for c in self.columns], F.lit(1))
        n = rows.agg(F.sum(tokens.cast("bigint")).alias("n")).first()["n"] or 1
        tasks = max(-(-n // TOKENS_AT_ONCE), min(self.spark.sparkContext.defaultParallelism, -(-n // LEAST_TOKENS)))
        return rows.repartition(tasks, "row") if versions == 1 else rows.repartitionByRange(tasks, "version", F.hash("row"))

    def _count(self, versions: list[str]) -> None:
        """Rows and total lengths of versions just written, from their markers, into the registry."""
        marks = self.store.read(versions).where(F.col("lead") == ROWS)
        sums = [F.sum(F.col("lens")[i]).alias(f"len{i}") for i in range(len(self.columns))]
        found = {r["version"]: r for r in marks.groupBy("version").agg(F.count("*").alias("n"), *sums).collect()}  # a row for each version
        built = self.store.built()
        for build in {built[v]["build"] for v in versions}:
            own = [v for v in versions if built[v]["build"] == build]
            told = {v: {"rows": built[v]["rows"], "n": found[v]["n"] if v in found else 0, "lens": [int(found[v][f"len{i}"]) if v in found else 0 for i in range(len(self.columns))]} for v in own}
            self.store.register(build, told)

    def versions(self) -> dict[str, dict]:
        return {v: b for v, b in self.store.built().items() if "n" in b}

    def postings(self, version: str, word: str, prefix: bool, exact: bool = False) -> DataFrame:
        """Occurrences of a word; exact: with case folded only."""
        found = self._found(version, [(word, prefix)], exact)
        return found.select("version", "token", F.coalesce("written", "token").alias("written"), "row", "col", F.explode("pos").alias("pos"), "lens")

    def _found(self, version: str, words: Sequence[tuple[str, bool]], exact: bool) -> DataFrame:
        """Postings of any of the words, by filters that prune folders and row groups."""
        return self.store.read([version]).where(reduce(lambda x, y: x | y, [_term(w, p, exact) for w, p in words]))

    def hits(self, version: str, phrases: Sequence[tuple[str, bool]], columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
        """(row, dl, tf0, tf1, ...) of rows that hold any of the phrases in one of the columns; (text, whether its last word is a prefix)."""
        split = [(words_of(p), prefix) for p, prefix in phrases]
        if not split or not all(ws for ws, _ in split):
            raise ValueError("a phrase without a word")
        cols = [self.columns.index(c) for c in columns] if columns else list(range(len(self.columns)))
        terms = [(i, j, w, prefix and j == len(ws) - 1) for i, (ws, prefix) in enumerate(split) for j, w in enumerate(ws)]
        found = self._found(version, [(w, p) for _, _, w, p in terms], exact).where(F.col("col").isin(cols))
        dl = reduce(lambda x, y: x + y, [F.col("lens")[c] for c in cols]).cast("bigint")
        if all(len(ws) == 1 for ws, _ in split):
            tf = [F.sum(F.when(_term(w, p, exact), F.size("pos")).otherwise(0)).alias(f"tf{i}") for i, _, w, p in terms]
            hits = found.groupBy("row").agg(F.max(dl).alias("dl"), *tf)
        else:
            speaks = F.array_compact(F.array(*[F.when(_term(w, p, exact), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))) for i, j, w, p in terms]))
            each = found.select("row", dl.alias("dl"), "col", "pos", speaks.alias("s")).repartition("row").select("row", "dl", "col", F.explode("pos").alias("pos"), "s").select("row", "dl", "col", "pos", F.explode("s").alias("s"))
            begins = each.groupBy("row", "col", F.col("s.i").alias("i"), (F.col("pos") - F.col("s.j")).alias("at")).agg(F.count("*").alias("said"), F.max("dl").alias("dl"))
            sizes = F.array(*[F.lit(len(ws)) for ws, _ in split])
            tf = [F.count_if(F.col("i") == i).alias(f"tf{i}") for i in range(len(split))]
            hits = begins.where(F.col("said") == sizes[F.col("i")]).groupBy("row").agg(F.max("dl").alias("dl"), *tf)
        return hits.where("dl > 0")  # all have; it keeps what counts them the same plan as what scores them, so that one exchange does for both

    def bm25(self, version: str, phrases: Sequence[tuple[str, bool]], columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
        """(row, score, tf0, ...) of rows that hold all phrases; the corpus figures are the registry's."""
        cols = [self.columns.index(c) for c in columns] if columns else list(range(len(self.columns)))
        corpus = self.versions()[version]
        n, avgdl = corpus["n"], sum(corpus["lens"][c] for c in cols) / max(corpus["n"], 1)
        hits = self.hits(version, phrases, columns, exact)
        counts = hits.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])
        score = F.lit(0.0)
        for i in range(len(phrases)):
            tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
            idf = F.greatest(F.log((F.lit(n) - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
        all_of = reduce(lambda x, y: x & y, [F.col(f"tf{i}") > 0 for i in range(len(phrases))])
        return hits.where(all_of).join(F.broadcast(counts)).select("row", score.alias("score"), *[f"tf{i}" for i in range(len(phrases))])


def _term(word: str, prefix: bool, exact: bool) -> Column:
    token = fold(word)
    lead = token[0] if re.match("[a-z0-9]", token) else OTHER
    here = F.col("lead") == lead
    here &= F.col("token").startswith(token) if prefix else F.col("token") == token
    if exact:
        written = F.coalesce("written", "token")
        here &= written.startswith(word.lower()) if prefix else written == word.lower()
    return here
