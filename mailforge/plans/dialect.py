"""Spelling of the few functions that Spark SQL and ANSI engines name differently; plans are written once over them."""

from __future__ import annotations

#: What Unicode counts as white space, and the information separators.
BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"


class Spark:
    name = "spark"

    def rx(self, x, pattern, to=""):
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    def quantile(self, x, p):
        return f"percentile({x}, {p})"

    def size(self, a):
        return f"size({a})"

    def window_list(self, x, over):
        return f"sort_array(collect_list({x}) over ({over}))"

    def at(self, a, i):
        return f"element_at({a}, cast({i} as int))"

    def number(self, x):
        return f"try_cast({x} as double)"

    def text(self, x):
        return f"cast({x} as string)"


class Duck(Spark):
    name = "duck"

    def rx(self, x, pattern, to=""):
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def quantile(self, x, p):
        return f"quantile_cont({x}, {p})"

    def size(self, a):
        return f"len({a})"

    def window_list(self, x, over):
        return f"list_sort(list({x}) over ({over}))"

    def at(self, a, i):
        return f"{a}[cast({i} as int)]"

    def text(self, x):
        return f"cast({x} as varchar)"

    def number(self, x):
        return f"try_cast({x} as double)"
