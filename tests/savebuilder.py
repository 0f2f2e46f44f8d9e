"""Small snapshot files for the tests, written from nested Python values."""

from __future__ import annotations


def written(value, depth: int = 0) -> str:
    """A value as it stands after ``=``: a list of (key, value) pairs and bare items is a block."""
    if not isinstance(value, list):
        return f"{value}\n"
    pad = "\t" * depth
    items = "".join(f"{pad}\t{x[0]}={written(x[1], depth + 1)}" if isinstance(x, tuple) else f"{pad}\t{x}\n" for x in value)
    return f"\n{pad}{{\n{items}{pad}}}\n"


def snapshot(date: str, player: str, flags: str, entries: list[tuple]) -> bytes:
    top = [("date", f'"{date}"'), ("player", f'"{player}"'), ("flags", [(f, "yes") for f in flags.split()]), ("start_date", '"1836.1.1"'), *entries]
    return "".join(f"{k}={written(v)}" for k, v in top).replace("\n", "\r\n").encode("latin-1")


def group(kind: str, number: int, people: int, culture: str, **more: float) -> tuple:
    return (kind, [("id", number), ("size", people), (culture, "animist"), *more.items()])


def land(number: int, holder: str | None, *groups: tuple, harbour: int = 0) -> tuple:
    held = [("owner", f'"{holder}"'), ("controller", f'"{holder}"'), ("core", f'"{holder}"')] if holder else []
    return (number, [("name", f'"Land {number}"'), *held, *([("naval_base", [("level", harbour)])] if harbour else []), *groups])


def realm(tag: str, culture: str, *more: tuple) -> tuple:
    return (tag, [("primary_culture", f'"{culture}"'), ("civilized", "yes"), ("prestige", "4.500"), *more])


def islands(date: str = "1836.1.1", fourth: str = "MIR") -> bytes:
    """Two nations: ZAN with 31,300 people on three lands, the third a colony, and MIR with 9,100 on the fourth."""
    letters = {"literacy": 0.25}
    zan = realm(
        "ZAN", "zanite", ("culture", ['"orlic"']), ("technology", [("sail_craft", ["1 1.000"]), ("far_trade", ["0 0.000"])]),
        ("state", [("provinces", ["11 12"]), ("state_buildings", [("building", '"mill"'), ("level", 3)])]), ("state", [("provinces", ["13"]), ("is_colonial", 2)]),
        ("army", [("name", '"Guard"'), ("regiment", [("type", "hussar"), ("pop", [("id", 901)]), ("strength", "2.500")]), ("regiment", [("type", "militia"), ("pop", [("id", 900)]), ("strength", "1.000")])]),
        ("navy", [("ship", [("type", "steamer"), ("strength", "80.000"), ("experience", "0.2")])]),
    )
    joined = [("1834.3.1", [("add_attacker", '"MIR"')]), ("1834.9.1", [("add_defender", '"ZAN"')])]
    return snapshot(date, "ZAN", "a b c d", [
        land(11, "ZAN", group("farmers", 900, 15000, "zanite", **letters, con=1.5, mil=1.0, life_needs=0.7), group("soldiers", 901, 4000, "zanite", **letters, life_needs=1.0), harbour=3),
        land(12, "ZAN", group("craftsmen", 902, 8000, "zanite", **letters, life_needs=0.9), group("farmers", 903, 2500, "orlic", **letters)),
        land(13, "ZAN", group("farmers", 904, 1200, "pelish", **letters), group("labourers", 905, 600, "zanite", **letters)),
        land(14, fourth, group("farmers", 906, 7000, "mirran", life_needs=0.01), group("clerks", 907, 2100, "mirran", life_needs=1.0)),
        land(15, None, group("farmers", 908, 400, "dusk")),
        zan, realm(fourth, "mirran"), ("great_nations", ["2 1"]),
        ("active_war", [("name", '"River War"'), ("history", joined), ("original_attacker", '"MIR"'), ("original_defender", '"ZAN"')]),
        ("worldmarket", [("price_pool", [("tea", "3.50000"), ("iron", "6.00000")]), ("supply_pool", [("tea", "14.00000")]), ("price_history", [("tea", "1.25000")]), ("price_history", [("tea", "2.75000")])]),
    ])
