import io
import json
import random
import re

from vellum import logs
from vellum.logs import Console, JsonLines, Logger

CLEAN = re.compile(r"[!-~]+")


def formatted(value):
    """A value as the rules have it: plain where it is printable ASCII without blanks, quotes and equals signs."""
    text = "<nil>" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    if CLEAN.fullmatch(text) and not set(text) & set('="'):
        return text
    return json.dumps(text)  # the same escapes for the characters that these tests draw


def dotted(pairs, prefix=()):
    for key, value in pairs:
        if isinstance(value, dict):
            yield from dotted(value.items(), prefix + ((key,) if key else ()))
        else:
            yield ".".join((*prefix, key)), value


def line(level, message, pairs):
    return " ".join([f"{level:<5} {message}", *(f"{formatted(k)}={formatted(v)}" for k, v in pairs)]) + "\n"


def drawn(rng, depth=0):
    kind = rng.randrange(7 if depth < 2 else 6)
    if kind == 6:
        return {f"g{rng.randrange(1000)}": drawn(rng, depth + 1) for _ in range(rng.randrange(3))}
    return [rng.randrange(-99, 99), rng.random() < 0.5, None, round(rng.uniform(-5, 5), 3), "".join(rng.choice("kwz=\" \t\n~/") for _ in range(rng.randrange(8))), "plain"][kind]


def pairs(rng):
    return {f"k{n}{rng.choice(['', ' b', '='])}": drawn(rng) for n in range(rng.randrange(5))}


def test_random_records_equal_a_plain_formatter():
    rng = random.Random(31)
    for _ in range(300):
        out = io.StringIO()
        level, given = rng.choice(sorted(logs.LEVELS)), pairs(rng)
        Logger(Console(out, "DEBUG", False)).log(level, "event seen", given.items())
        assert out.getvalue() == line(level, "event seen", dotted(given.items()))


def test_random_chains_of_derived_loggers():
    rng = random.Random(32)
    for _ in range(200):
        out = io.StringIO()
        log, prefix, kept = Logger(Console(out, "DEBUG", False)), (), []
        for n in range(rng.randrange(5)):
            if rng.random() < 0.4:
                prefix = (*prefix, f"part{n}")
                derived = log.group(f"part{n}")
            else:
                own = {f"b{n}": drawn(rng)}
                kept += list(dotted(own.items(), prefix))
                derived = log.bind(**own)
            log.bind(lost=1).group("lost")  # leaves its parent as it is
            log = derived
        own = pairs(rng)
        log.log("WARN", "chained", own.items())
        assert out.getvalue() == line("WARN", "chained", [*kept, *dotted(own.items(), prefix)])


def test_each_level_hides_what_is_below_it():
    names = sorted(logs.LEVELS, key=logs.LEVELS.get)
    for k, least in enumerate(names):
        out = io.StringIO()
        console = Console(out, names[-1], False)
        log = Logger(console)
        console.level = least  # takes effect at once
        for write in (log.debug, log.info, log.warning, log.error):
            write("tick")
        assert out.getvalue().split() == [x for name in names[k:] for x in (name, "tick")]


def test_unprintable_characters_are_escaped_by_code_point():
    for c in ("\x00", "\x7f", "\u200b", "\u2028", "\U000e0001"):
        escape = logs.quoted(f"q{c}")[2:-1]
        assert chr(int(escape[2:], 16)) == c and len(escape) in (4, 6, 10)
    assert logs.quoted("ünï-日本") == "ünï-日本" and logs.quoted("") == '""'


def test_colours_wrap_levels_and_keys_only(monkeypatch):
    for level, colour in logs.COLORS.items():
        out, plain = io.StringIO(), io.StringIO()
        for stream, on in ((out, True), (plain, False)):
            Logger(Console(stream, "DEBUG", on)).log(level, "tinted", [("size", 5), ("two words", "v")])
        assert re.sub("\x1b\\[[0-9;]*m", "", out.getvalue()) == plain.getvalue()
        assert out.getvalue().startswith(colour + level + logs.RESET) and out.getvalue().count(logs.DIM) == 2
    monkeypatch.delenv("NO_COLOR", raising=False)
    terminal = type("Terminal", (io.StringIO,), {"isatty": lambda self: True})()
    monkeypatch.setenv("TERM", "xterm")
    assert logs.use_color(terminal) and not logs.use_color(io.StringIO())
    monkeypatch.setenv("TERM", "dumb")
    assert not logs.use_color(terminal)


def test_json_lines_nest_groups_and_go_on_in_the_same_file(tmp_path):
    rng, path, expected = random.Random(33), str(tmp_path / "a" / "b.jsonl"), []
    for n in range(12):
        handler = JsonLines(path)
        value = rng.choice([n, str(n), None, n % 2 == 0, n / 8])
        Logger(handler).group("outer").bind(run=n).group("inner").debug(f"step {n}", value=value)
        handler.close()
        expected.append((f"step {n}", {"run": n, "inner": {"value": value}}))
    rows = [json.loads(x) for x in open(path, encoding="utf-8")]
    assert [(r["msg"], r["outer"]) for r in rows] == expected and {r["level"] for r in rows} == {"DEBUG"}
    assert sorted(r["time"] for r in rows) == [r["time"] for r in rows]
