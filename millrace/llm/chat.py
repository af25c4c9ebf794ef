"""Chat formatting in DataFrame functions: a finite-state machine over roles checks the order of the
turns; a declarative template turns them into text segments, each with a loss flag.

Control strings inside a text are escaped reversibly: of what open and close begin with, two characters, the
first followed by any number of "\\" and then the second gets one "\\" more, so no text can hold either mark.
Roles are escaped alike, and have "%" and what after_role begins with percent-coded. A template whose marks can't
be told from texts in this way is refused when it is made.

Null texts and roles are empty; equal turns are ordered by role and text; repeated rows are turns of their own;
rows without conv_id are one conversation without id. Texts are formatted whole, however long. A conversation is
one row, its turns sorted by one task. A sequence that the machine refuses is still formatted, with valid false.
Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + after_role + text + close for each turn, and the machine's moves (state, role) -> state."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    def __post_init__(self):
        for mark in (self.open, self.close):
            if len(mark) < 2 or "\\" in mark[:2] or mark[0] == mark[1]:
                raise ValueError(f"{mark!r}: a mark must begin with two different characters, neither a backslash")
        if not re.match(r"[^%\\0-9A-Za-z\x80-\U0010ffff]", self.after_role) or self.after_role[0] == self.close[1]:
            raise ValueError(f"{self.after_role!r}: what follows a role must begin with an ASCII sign other than % and backslash, not the second of close")
        ends = [mark[i:] for mark in (self.open, self.after_role) for i in range(len(mark))]
        if any(x.startswith(self.close) or self.close.startswith(x) for x in ends):
            raise ValueError(f"{self.close!r}: what ends a turn must not be, or begin, within what starts it")

    def escape(self, c: Column) -> Column:
        for first, second in self.starts():
            c = F.regexp_replace(c, rf"({first})(\\*)(?={second})", r"$1\\$2")
        return c

    def unescape(self, c: Column) -> Column:
        for first, second in self.starts()[::-1]:
            c = F.regexp_replace(c, rf"({first})\\(\\*)(?={second})", r"$1$2")
        return c

    def starts(self) -> list[tuple[str, str]]:
        """Patterns of the first and second characters of the marks, the same first ones together."""
        seconds: dict[str, str] = {}
        for mark in (self.open, self.close):
            seconds[mark[0]] = seconds.get(mark[0], "") + re.escape(mark[1])
        return [(re.escape(first), f"[{second}]") for first, second in seconds.items()]

    def code_role(self, c: Column) -> Column:
        mark = self.after_role[0]
        return self.escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(mark), F.lit(f"%{ord(mark):02X}")))

    def decode_role(self, c: Column) -> Column:
        mark = self.after_role[0]
        return F.replace(F.replace(self.unescape(c), F.lit(f"%{ord(mark):02X}"), F.lit(mark)), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, valid, segments array<struct<text, loss>> and formatted of conversations (conv_id, turn, role, text)."""
    t = template
    grouped = (
        turns.select(
            "conv_id",
            F.struct(
                "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
    )
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])
    end = F.aggregate(
        "turns", F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), x.role)), F.lit(""))
    )
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                seg(F.concat(F.lit(t.open), t.code_role(x.role), F.lit(t.after_role)), F.lit(False)),
                seg(t.escape(x.text), x.role.isin(*t.loss_roles)),
                seg(F.lit(t.close), F.lit(False)),
            ),
        )
    )
    return grouped.select("conv_id", end.isin(*t.final).alias("valid"), segments.alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s.text), "")
    )


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, valid, turns array<struct<role, text>>, loss_texts array<string>, formatted: the turns parsed from
    the formatted text, the loss texts from the segments under the mask."""
    t = template
    pieces = F.split("formatted", re.escape(t.close))
    body = lambda x: F.substring(x, F.lit(len(t.open) + 1), F.length(x))
    turns = F.transform(
        F.transform(F.slice(pieces, 1, F.size(pieces) - 1), body),  # nothing follows the last mark
        lambda x: F.struct(
            t.decode_role(F.substring_index(x, t.after_role, 1)).alias("role"),
            t.unescape(F.substring(x, F.instr(x, t.after_role) + len(t.after_role), F.length(x))).alias("text"),
        ),
    )
    loss = F.transform(F.filter("segments", lambda s: s.loss), lambda s: t.unescape(s.text))
    return chats.select("conv_id", "valid", turns.alias("turns"), loss.alias("loss_texts"), "formatted")


def digest(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """The read-back digest of each conversation."""
    sha = lambda c: F.sha2(c, 256)
    back = read_back(chats, template)
    text = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(text).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
