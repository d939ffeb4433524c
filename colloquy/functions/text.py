"""Text functions as column expressions: tokenizers, normalisers, phrases, classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists that terms, phrases and miners leave out.
FUNCTION_WORDS = (
    "the and but nor not you your yours our ours their theirs its his her hers this that these those they them then than "
    "there here what when where which while who whom whose why how all any both each few more most other others some such only "
    "own same very can cannot could did does done doing has have had having was were been being are will would should may might "
    "must shall into onto over under between through during before after above below from with without within about against again "
    "further once out off now just also too one two first second next last new still yet per via use using used uses get "
    "gets got make makes made let lets see want wants need needs way ways well like back because instead rather already itself "
    "yourself themselves something anything everything nothing"
).split()
OPENING_STOPS = (
    "ok so i we the a an to is it this that of for and or but im now yes no good well oh my do us you can be are "
    "just also then thats its ive lets let still if in on at"
).split()
DANGLING = "a an the to of for and or with per at".split()
MINER_STOPS = (
    "the a an and or but of to in on for with is are was were be been it this that i you we they he she my your our its at as by from not no "
    "yes do does did have has had will would can could should just so then than when what how why where which there here also very really"
).split()
FILLERS = "ok okay now then and yes also next lets go please sure wait".split()
NUMBERED = "a numbered reply (1. … 2. …)"
WRAPPERS = (
    "task-notification command-name command-message command-args command-contents system-reminder local-command-stdout "
    "local-command-stderr bash-input bash-stdout bash-stderr"
).split()
COMMANDS = "git pnpm npm gh node npx python3? corepack curl mkdir cp mv sed grep find ls cat".split()
APPROVAL = "^(ok good|good good|exactly|perfect|nice|beautiful|love it|this is good|yes exactly|great|ok great|clear)\\b"

#: White space of scripts and of Unicode's separators, no-break spaces and the byte order mark among it.
WHITE = " \t\n\r\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACES = f"[{WHITE}]+"


def trim_white(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    """Nothing but white space; no more is read than up to the first other character."""
    return ~c.rlike(f"[^{WHITE}]")


def squeeze(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


# What words of replies, prompts and quotes are made of; all else parts them.
PHRASE, PROMPT, QUOTE = "a-z0-9'", "a-z0-9'/.-", "a-z0-9"


def words_of(c: Column, letters: str, first: int | None = None) -> Column:
    """The words of a text, lower-cased; of the first so many no more of the text is read."""
    text = F.lower(c)
    if first:
        text = F.regexp_extract(text, f"^[^{letters}]*+(?:[{letters}]++[^{letters}]++){{0,{first - 1}}}+[{letters}]*+", 0)
    return F.regexp_extract_all(text, F.lit(f"[{letters}]+"), F.lit(0))


def normal_phrase(c: Column) -> Column:
    return F.array_join(words_of(c, PHRASE), " ")


def normal_prompt(c: Column, first: int | None = None) -> Column:
    return F.array_join(words_of(c, PROMPT, first), " ")


def normal_quote(c: Column) -> Column:
    return F.array_join(words_of(c, QUOTE), " ")


def without_digits(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "[0-9]+", ""))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def literals(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def among(items: list[str]):
    """A test of membership in a word list, for use inside lambdas."""
    return lambda w: w.isin(*items)


def tokens(c: Column) -> Column:
    """Words of two characters or more that start with a letter."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z0-9_.-]{1,})"), 1)


def raw_terms(c: Column) -> Column:
    """Every match of the term pattern, lower-cased, without marks at its end; filtered ones stay, for their positions."""
    return F.transform(F.regexp_extract_all(c, F.lit("([a-zA-Z][a-zA-Z0-9_.-]{2,})"), 1), lambda t: F.regexp_replace(F.lower(t), "[._-]+$", ""))


def is_term(t: Column, machine: tuple[str, ...] = ()) -> Column:
    return F.length(t).between(3, 40) & ~t.isin(*FUNCTION_WORDS, *machine)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where f names c several times: as the argument of a lambda it is computed once for a row."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def phrases(c: Column) -> Column:
    """Distinct candidate phrases of a reply: openings of two to four words, a short whole, a numbered list."""
    numbered = F.when(c.rlike("^\\s*\\d+[.)]"), F.lit(NUMBERED))

    def of(w: Column) -> Column:
        n = F.size(w)
        openings = [F.when(n >= k, F.array_join(F.slice(w, 1, k), " ")) for k in (2, 3, 4)]
        whole = F.when(n.between(1, 5), F.array_join(w, " "))
        return F.array_distinct(F.array_compact(F.array(numbered, *openings, whole)))

    return once(words_of(c, PHRASE, first=6), of)  # a sixth word tells that the text is no short whole


def all_stop(phrase: Column) -> Column:
    return (phrase != NUMBERED) & F.forall(F.split(phrase, " "), among(OPENING_STOPS))


def ends_dangling(phrase: Column) -> Column:
    return (phrase != NUMBERED) & F.element_at(F.split(phrase, " "), -1).isin(*DANGLING)


def is_machine_artifact(phrase: Column, host: str, user: str) -> Column:
    """The phrase lies within the words of host and user, or starts with the host's first word or the user."""
    import re

    plain = lambda s: " ".join(re.sub("[^a-z0-9\\s']", " ", s.lower()).split())
    text, leads = f" {plain(f'{host} {user}')} ", [x for x in {plain(host).split(" ")[0], plain(user)} if x]
    inside = F.lit(text).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))
    return (phrase != NUMBERED) & (inside | F.split(phrase, " ")[0].isin(*leads))


def has_numeral(c: Column) -> Column:
    return c.rlike("\\p{N}")


def word_count(c: Column) -> Column:
    return F.when(trim_white(c) == "", 0).otherwise(F.size(F.split(trim_white(c), SPACES)))


def is_question(c: Column) -> Column:
    return trim_white(c).rlike("\\?$")


def clip(c: Column, n: int) -> Column:
    return F.substring(squeeze(c), 1, n)


def strip_wrappers(c: Column) -> Column:
    """Without injected blocks and bare tags; the text of a continued session is no text."""
    out = F.regexp_replace(c, f"(?s)<({'|'.join(WRAPPERS)})>.*?</\\1>", " ")
    out = trim_white(F.regexp_replace(out, "</?[a-z-]+>", " "))
    return F.when(out.startswith("This session is being continued"), "").otherwise(out)


def interrupt_kind(c: Column) -> Column:
    return F.when(c.rlike("(?i)\\[Request interrupted by user for tool use\\]"), "tool-use").when(c.rlike("(?i)\\[Request interrupted by user"), "plain")


def refusal_kind(output: Column) -> Column:
    body = trim_white(output)
    system = body.startswith("rejected by configuration") | body.startswith("automatic approval review denied")
    person = body.startswith("aborted by user") | body.startswith("rejected by user")
    return F.when(system, "automode-blocked").when(person, "user-rejected")


def shape(c: Column, vocabulary: Column) -> Column:
    """The text with words outside the vocabulary deleted in place; the text itself if nothing is left."""
    runs = F.regexp_extract_all(c, F.lit("([a-zA-Z][a-zA-Z0-9_.-]+|[^a-zA-Z]+|.)"), 1)
    kept = F.transform(runs, lambda r: F.when(r.rlike("^[a-zA-Z][a-zA-Z0-9_.-]+$") & ~F.array_contains(vocabulary, F.lower(r)), "").otherwise(r))
    out = squeeze(F.array_join(kept, ""))
    return F.when(out == "", c).otherwise(out)


def basename(path: Column) -> Column:
    return F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1))


def project_of(cwd: Column, home: str) -> Column:
    rel = F.when(cwd.startswith(f"{home}/"), F.substring(cwd, len(home) + 2, 1 << 20)).otherwise(cwd)
    return F.coalesce(F.nullif(rel, F.lit("")), basename(cwd), cwd)


def command_verb(command: Column) -> Column:
    """A known tool and its sub-command; null for others, and for a tool alone."""
    pattern = f"^({'|'.join(COMMANDS)})\\s+(\\S+)?"
    text = F.ltrim(command)
    tool, sub = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    sub = F.substring(F.regexp_replace(sub, "^-.*", ""), 1, 12)
    return F.when(tool == "", None).when(sub == "", tool).otherwise(F.concat_ws(" ", tool, sub))


def tool_name(name: Column, input_: Column) -> Column:
    declared = F.coalesce(F.nullif(trim_white(name), F.lit("")), F.lit("exec"))
    called = F.nullif(F.regexp_extract(input_, "\\btools\\.([A-Za-z_][A-Za-z0-9_]*)\\s*\\(", 1), F.lit(""))
    inner = F.when(input_.contains("*** Begin Patch"), "apply_patch").otherwise(F.coalesce(called, declared))
    return F.when((declared != "exec") | F.coalesce(input_ == "", F.lit(True)), declared).otherwise(inner)


def skill_names(input_: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(input_, F.lit("skills/((?:\\.system/)?[A-Za-z0-9._-]+)/SKILL\\.md"), 1))


def when_clause(line: Column) -> Column:
    """(condition, action) of a line 'when X, Y'."""
    pattern = "(?i)^when\\s+([^,]+),\\s*(.+)$"
    return F.struct(F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).alias("condition"), F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")).alias("action"))


def version_key(version: Column) -> Column:
    """Dotted versions as arrays that compare by their numbers."""
    return F.transform(F.split(version, "\\."), lambda x: F.coalesce(F.try_to_number(x, F.lit("999999999")).cast("long"), F.lit(0)))
