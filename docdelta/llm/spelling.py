"""Spelling variants of the words of a corpus, by a variable-length gram index.

Words are counted over all texts, after a rule that damages one occurrence list in 199. The gram
dictionary holds the grams that stay frequent over all words: a gram grows until it is rare, as long as
its class allows, or at the word's end, so common syllables give longer grams than rare ones. Each
place of a word has one gram, and finding it looks at a window of characters from that place on (and
at the end of the word, if it grew into it). An edit affects a gram only if it lies in that window.

Two words that differ by one edit share every gram that the edit doesn't affect. So of any grams of a
word, no more are lost than there are windows over one point: that bounds the grams a word must still
share. The lists that a word asks are the cheapest grams whose bound leaves one over. On a line such
grams always include two with windows apart, so two lists are enough: every near word is in one of them.
Lists are keyed by class, gram and place. Words of L characters ask words of L (replaced) and of L - 1
characters (deleted; the gram at its place, or one before); classes differ in the longest gram allowed,
half a word, so that two windows apart exist. What a list gives is verified by edit distance.

Lists are joined by Spark, by sorting on both sides, and no list is ever collected or broadcast. What is
broadcast is bounded: at most FREQUENT grams of each length, and the counts of pairs of letters of a fixed alphabet.

Null and empty texts have no runs. A null doc_id stands as empty text in the rule's key; rows of equal
ids and texts are separate rows, each counted. A text of any length is read in pieces cut between runs.
Words of equal count and no near word are roots of themselves. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm.common import bounded_batches, give_back, id_and_text, slices, stored, table, unsized

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, DAMAGED, TIMES = 6, 5, 199, 5
#: Lengths of grams; the longest is also at most half of the asking word.
SHORTEST, LONGEST = 2, 6
#: Most frequent grams of one length: what a task holds of the dictionary. A gram is rare if it is in fewer than one in so many places.
FREQUENT = 50_000
#: Characters of a piece of a long text; distinct words that a task counts before it passes them on.
PIECE, HELD = 1 << 20, 200_000


# ---- words


def pieces(text: str) -> Iterator[str]:
    """text cut where no run is, every PIECE characters or at the end of the run that is there."""
    start = 0
    while start < len(text):
        end = start + PIECE
        run = RUN.match(text, end) if end < len(text) else None
        end = run.end() if run else min(end, len(text))
        yield text[start:end]
        start = end


def damage(run: str, doc_id: int | None) -> str:
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % DAMAGED == 0 else run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a partition's texts; a word may come several times, each with a part of its count."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in (x for b in batches for x in slices(b)):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            runs: Counter[str] = Counter()
            for piece in pieces((text or "").encode().lower().decode()):  # of bytes: changes A-Z alone
                runs.update(RUN.findall(piece))
            for run, n in runs.items():
                if len(run) >= LEAST_LENGTH and len(word := damage(run, doc_id)) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) > HELD:
                yield out()
    yield out()
    give_back()


def words(docs: DataFrame) -> DataFrame:
    """(word, n): distinct words of at least LEAST_LENGTH characters and LEAST_COUNT occurrences."""
    counts = docs.mapInArrow(counted, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- the gram dictionary


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            for q in range(SHORTEST, LONGEST):
                held.update(word[i : i + q] for i in range(len(word) - q + 1))
        if len(held) > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["gram", "n"])
            held.clear()
    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["gram", "n"])


class Grams:
    """The pruned dictionary: which grams are frequent, and an estimate of how long the list of a gram is."""

    def __init__(self, counts: dict[str, int]):
        self.frequent = frozenset(counts)
        self.pairs = {g: n for g, n in counts.items() if len(g) == SHORTEST}
        self.letters: Counter[str] = Counter()
        for g, n in self.pairs.items():
            self.letters[g[0]] += n

    def windows(self, word: str, longest: int) -> list[tuple[int, int, str]]:
        """(place, end of its window, gram) for each place of word; a window over the word's end counts one more character."""
        out = []
        for p in range(len(word) - SHORTEST + 1):
            q = SHORTEST
            while q < longest and word[p : p + q] in self.frequent:
                if p + q == len(word):
                    q += 1  # it would have grown on: what follows the word counts
                    break
                q += 1
            out.append((p, p + q, word[p : min(p + q, len(word))]))
        return out

    def cost(self, gram: str) -> float:
        """About the number of words with that gram, if a letter hangs on the one before it alone."""
        n = float(self.pairs.get(gram[:2], 1))
        for i in range(1, len(gram) - 1):
            n *= self.pairs.get(gram[i : i + 2], 1) / max(self.letters.get(gram[i], 1), 1)
        return n

    def asked(self, word: str, longest: int) -> list[tuple[int, str]]:
        """The two cheapest grams that no one edit affects both: their windows have no character in common."""
        costs = [(self.cost(g), p, end, g) for p, end, g in self.windows(word, longest)]
        apart = ((a, b) for a, b in combinations(costs, 2) if a[2] <= b[1])
        a, b = min(apart, key=lambda ab: (ab[0][0] + ab[1][0], ab[0][1], ab[1][1]))
        return [(a[1], a[3]), (b[1], b[3])]


def dictionary(found: DataFrame) -> Grams:
    """The grams that are in more than one of FREQUENT places, of words each once; so no length has more than FREQUENT."""
    grams = found.select("word").mapInArrow(_gram_counts, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    places = found.agg(F.sum(F.length("word"))).first()[0] or 0
    # Pairs of letters are all kept, as estimates need them: a word has 26 + 64 letters to choose from.
    kept = grams.where((F.length("gram") == SHORTEST) | (F.col("n") > places / FREQUENT)).collect()
    return Grams({r.gram: r.n for r in kept})


# ---- lists


def _key(asking: int, listed: int, place: int, gram: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{asking} {listed} {place} {gram}") - (1 << 63)


def _entries(grams, asking: bool):
    """A mapInArrow function of (word, n): the keys that a word asks, or those it is listed under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grams.value
        for batch in batches:
            key, at = [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                size = len(word)
                if asking:
                    for p, gram in g.asked(word, min(LONGEST, size // 2)):
                        keys = [_key(size, size, p, gram), _key(size, size - 1, p, gram)]
                        key += keys + ([_key(size, size - 1, p - 1, gram)] if p else [])
                        at += [i] * (2 + bool(p))
                else:
                    for larger in (size, size + 1):
                        listed = [_key(larger, size, p, gram) for p, _, gram in g.windows(word, min(LONGEST, larger // 2))]
                        key += listed
                        at += [i] * len(listed)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), rows.column("word"), rows.column("n")], ["key", "word", "n"])
        give_back()

    return run


def near_words(found: DataFrame) -> DataFrame:
    """(a, na, b, nb): every two words that differ by one inserted, deleted or replaced character, once."""
    spark = found.sparkSession
    grams = spark.sparkContext.broadcast(dictionary(found))
    schema = "key bigint, word string, n bigint"
    ask = found.mapInArrow(_entries(grams, True), schema).select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    listed = found.mapInArrow(_entries(grams, False), schema).select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    once = (F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))
    both = ask.join(unsized(listed), "key").where(once & (F.levenshtein("a", "b", 1) == 1))
    return both.select("a", "na", "b", "nb").distinct()


# ---- forms and roots


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: (word, form). Each round doubles the steps; a form is TIMES its word's n, so chains are short."""
    links = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(links.join(unsized(on), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        links = new.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    bounded_batches(docs.sparkSession)
    found = stored(words(id_and_text(docs, id_col, text_col)), "words")
    near = near_words(found)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    far = -F.col("best.less") >= TIMES * F.col("n")
    out = found.join(unsized(best), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n"))
    out = stored(out, "variants")
    ends = roots(out.where("form is not null").select("word", "form"))
    return out.join(unsized(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 as SQL: `t` has the table of its 256 entries, by its rule; bytes are those of a text in UTF-8 up to ÿ.
CRC_TABLE = """t as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as crc)"""


def crc32_sql(text: str) -> str:
    bytes_ = f"flatten(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [192 + ord(c)::bigint // 64, 128 + ord(c)::bigint % 64] end))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda h, b: xor(h // 256, crc[xor(h, b) % 256 + 1])))"


SQL = rf"""
with recursive {CRC_TABLE},
runs as (select doc_id, r, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as r from documents) where length(r) >= 6 group by all),
hashed as (select r, n, {crc32_sql("concat(doc_id, ':', r)")} as h from runs, t),
w as (select word, sum(n)::bigint as n from (select case when h % 199 = 0 then r[1:h % length(r)] || r[h % length(r) + 2:] else r end as word, n from hashed) where length(word) >= 6 group by word having sum(n) >= 5),
gone as (select word, i, word[1:i - 1] || word[i + 1:] as rest from w, unnest(generate_series(1, length(word))) as u(i)),
near as (select a.word, b.word as other from gone a join gone b using (i, rest) where a.word <> b.word union select g.word, w.word from gone g join w on w.word = g.rest union select w.word, g.word from gone g join w on w.word = g.rest),
best as (select near.word, count(*) as n_near, arg_min(other, (-w.n, other)) as other, max(w.n) as m from near join w on w.word = other group by near.word),
v as (select word, n, coalesce(n_near, 0) as n_near, case when m >= 5 * n then other end as form, case when m >= 5 * n then m end as form_n from w left join best using (word)),
ends as (select word, word as root, form as further from v union all select e.word, e.further, v.form from ends e join v on v.word = e.further)
select word, form, root, n, n_near, form_n from v join (select word, root from ends where further is null) using (word)
"""
