"""SQL fragments that Spark and DuckDB spell differently, so that one plan text serves as query and as oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

WORD = r"[\p{L}\p{N}_]+"


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def rx(self, pattern: str) -> str:
        """A literal in which backslashes stand for themselves."""
        pattern = pattern.replace("'", r"\x27")
        return f"r'{pattern}'" if self.spark else f"'{pattern}'"

    def find_all(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {self.rx(pattern)}, {group})"

    def replace_all(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.rx(pattern)}, '{by}'" + (")" if self.spark else ", 'g')")

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_like({text}, {self.rx(pattern)})" if self.spark else f"regexp_matches({text}, {self.rx(pattern)})"

    def each(self, array: str, name: str, expr: str) -> str:
        return f"transform({array}, {name} -> {expr})" if self.spark else f"list_transform({array}, lambda {name}: {expr})"

    def keep(self, array: str, name: str, expr: str) -> str:
        return f"filter({array}, {name} -> {expr})" if self.spark else f"list_filter({array}, lambda {name}: {expr})"

    def size(self, array: str) -> str:
        return f"CAST({'size' if self.spark else 'len'}({array}) AS BIGINT)"

    def distinct(self, array: str) -> str:
        return f"{'array' if self.spark else 'list'}_distinct({array})"

    def least(self, array: str) -> str:
        return f"{'array' if self.spark else 'list'}_min({array})"

    def total(self, array: str) -> str:
        return f"aggregate({array}, 0L, (a, x) -> a + x)" if self.spark else f"coalesce(list_sum({array}), 0)::BIGINT"

    def part(self, array: str, start: str, n: int) -> str:
        return f"slice({array}, {start}, {n})" if self.spark else f"{array}[{start}:{start} + {n - 1}]"

    def glue(self, array: str, by: str = " ") -> str:
        return f"array_join({array}, '{by}')" if self.spark else f"array_to_string({array}, '{by}')"

    def upto(self, n: str) -> str:
        """1 to n; empty if n is below 1."""
        return f"CASE WHEN {n} < 1 THEN array() ELSE sequence(1, CAST({n} AS INT)) END" if self.spark else f"range(1, {n} + 1)"

    def rows(self, array: str) -> str:
        return f"{'explode' if self.spark else 'unnest'}({array})"

    def lines(self, text: str) -> str:
        return self.keep(self.each(f"split({text}, r'\\n')" if self.spark else f"string_split({text}, chr(10))", "x", "trim(x)"), "x", "x <> ''")

    def words(self, text: str) -> str:
        return self.find_all(f"lower({text})", WORD)

    def normal(self, text: str) -> str:
        return f"trim({self.replace_all(f'lower({text})', '[^\\p{L}\\p{N}]+', ' ')})"

    def grams(self, words: str, n: int) -> str:
        """All n-grams of a word list; of a shorter list its whole, so each list gives one at least."""
        inner = self.each(self.upto(f"{self.size(words)} - {n - 1}"), "i", self.glue(self.part(words, "i", n)))
        return f"CASE WHEN {self.size(words)} < {n} THEN {'array' if self.spark else 'list_value'}({self.glue(words)}) ELSE {inner} END"

    def glue_numbers(self, array: str, by: str = ",") -> str:
        return self.glue(f"CAST({array} AS ARRAY<STRING>)" if self.spark else array, by)

    def top_counts(self, text: str) -> str:
        """How often the most frequent gram of 2, 3 and 4 characters occurs, as a list; 0 where the text is shorter."""
        if self.spark:
            return f"top_grams({text})"
        grams = (self.each(self.upto(f"length({text}) - {n - 1}"), "i", f"substring({text}, i, {n})") for n in (2, 3, 4))
        return f"[{', '.join(f'CAST(coalesce(list_max(map_values(list_aggregate({g}, {chr(39)}histogram{chr(39)}))), 0) AS BIGINT)' for g in grams)}]"

    def at(self, array: str, i: int) -> str:
        """The i-th element, from 0."""
        return f"{array}[{i if self.spark else i + 1}]"

    def hash_grams(self, words: str, n: str) -> str:
        """64-bit hashes of all n-grams of a word list, in Spark alone: a filter that loses nothing, before grams are compared."""
        return self.each(self.upto(f"size({words}) - {n} + 1"), "i", f"xxhash64(slice({words}, CAST(i AS INT), CAST({n} AS INT)))")

    def hash32(self, *parts: str) -> str:
        """32 bits of a hash over the parts as a number."""
        digits = f"substr(md5(concat({', '.join(parts)})), 1, 8)"
        return f"CAST(conv({digits}, 16, 10) AS BIGINT)" if self.spark else f"CAST(('0x' || {digits}) AS BIGINT)"

    def median(self, x: str, q: float = 0.5) -> str:
        return f"percentile({x}, {q})" if self.spark else f"quantile_cont({x}, {q})"

    def even(self, x: str) -> str:
        return f"bround({x})" if self.spark else f"round_even({x}, 0)"

    def seconds(self, a: str, b: str) -> str:
        return f"(unix_micros(CAST({b} AS TIMESTAMP)) - unix_micros(CAST({a} AS TIMESTAMP))) / 1e6" if self.spark else f"(epoch_us({b}) - epoch_us({a})) / 1e6"

    def word_count(self, text: str) -> str:
        """Runs of other than white space; in Spark without a list of them, each run as one letter."""
        if self.spark:
            words, blank = self.rx(r"\S+"), self.rx(r"\s+")
            return f"CAST(length(regexp_replace(regexp_replace({text}, {words}, 'a'), {blank}, '')) AS BIGINT)"
        return self.size(self.find_all(text, r"\S+"))

    def approx_tokens(self, text: str) -> str:
        """A token for every six letters of a run, or part of them, for each digit and for each other sign."""
        if self.spark:  # letters of a token as one; what stays beside white space is a token each
            letters, blank = self.rx("[A-Za-z]{1,6}"), self.rx(r"\s+")
            return f"CAST(coalesce(length(regexp_replace(regexp_replace({text}, {letters}, 'a'), {blank}, '')), 0) AS BIGINT)"
        pieces = self.find_all(text, r"[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]")
        return self.total(self.each(pieces, "x", "CAST(greatest(1, ceil(length(x) / 6.0)) AS BIGINT)"))


SPARK, DUCK = Dialect(True), Dialect(False)
Plan = Callable[[Dialect], str]
