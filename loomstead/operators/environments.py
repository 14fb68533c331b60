"""State machines as folds over call arrays; one fold per environment, whole trajectories in one expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What the environments accept.
FRUITS = ("apples", "bananas", "oranges", "grapes", "mangoes")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
TITLES = ("Standup", "Review", "1:1", "Planning", "Demo")


def _ok(state: Column, ok: Column, reason: Column, **fields: Column) -> Column:
    names = [f for f in fields]
    return F.struct(*[fields[n].alias(n) for n in names], (state["applied"] + ok.cast("int")).alias("applied"), F.concat(state["reasons"], F.array(reason)).alias("reasons"))


def cart(calls: Column, check_items: bool = True) -> Column:
    """Fold of calls (name, item, quantity) over an empty cart: items in order of arrival, checked_out, applied, reasons.

    A failed call leaves the state as it is. Items keep the order they came in, so they are
    an array of (item, quantity), not a map.
    """
    zero = F.struct(F.expr("cast(array() as array<struct<item:string,quantity:bigint>>)").alias("items"), F.lit(False).alias("checked_out"), F.lit(0).alias("applied"), F.expr("cast(array() as array<string>)").alias("reasons"))

    def step(s: Column, c: Column) -> Column:
        have = F.coalesce(F.get(F.filter(s["items"], lambda x: x["item"] == c["item"]), F.lit(0))["quantity"], F.lit(0).cast("bigint"))
        good = (c["quantity"] > 0) & (c["item"].isin(*FRUITS) if check_items else c["item"].isNotNull())
        known = F.exists(s["items"], lambda x: x["item"] == c["item"])
        line = F.struct(c["item"].alias("item"), c["quantity"].cast("bigint").alias("quantity"))
        added = F.when(known, F.transform(s["items"], lambda x: F.struct(x["item"].alias("item"), F.when(x["item"] == c["item"], x["quantity"] + c["quantity"]).otherwise(x["quantity"]).alias("quantity")))).otherwise(F.concat(s["items"], F.array(line)))
        fewer = F.filter(F.transform(s["items"], lambda x: F.struct(x["item"].alias("item"), F.when(x["item"] == c["item"], x["quantity"] - c["quantity"]).otherwise(x["quantity"]).alias("quantity"))), lambda x: x["quantity"] > 0)
        name = c["name"]
        reason = (
            F.when(s["checked_out"], "cart already checked out")
            .when((name == "add_item") & ~F.coalesce(good, F.lit(False)), "bad add args").when(name == "add_item", "ok")
            .when((name == "remove_item") & ~F.coalesce(good, F.lit(False)), "bad remove args").when((name == "remove_item") & (c["quantity"] > have), "removing more than present").when(name == "remove_item", "ok")
            .when((name == "checkout") & (F.size(s["items"]) == 0), "cannot check out empty cart").when(name == "checkout", "ok")
            .otherwise(F.concat(F.lit("unknown tool "), name))
        )
        ok = reason == "ok"
        items = F.when(ok & (name == "add_item"), added).when(ok & (name == "remove_item"), fewer).otherwise(s["items"])
        return _ok(s, ok, reason, items=items, checked_out=s["checked_out"] | (ok & (name == "checkout")))

    return F.aggregate(calls, zero, step)


def calendar(calls: Column, check_values: bool = True) -> Column:
    """Fold of calls (name, title, day) over an empty calendar: events in order of arrival, applied, reasons."""
    zero = F.struct(F.expr("cast(array() as array<struct<title:string,day:string>>)").alias("events"), F.lit(0).alias("applied"), F.expr("cast(array() as array<string>)").alias("reasons"))

    def step(s: Column, c: Column) -> Column:
        known = F.exists(s["events"], lambda x: x["title"] == c["title"])
        good = (c["title"].isin(*TITLES) & c["day"].isin(*DAYS)) if check_values else (c["title"].isNotNull() & c["day"].isNotNull())
        day = c["day"].isin(*DAYS) if check_values else c["day"].isNotNull()
        name = c["name"]
        reason = (
            F.when((name == "create_event") & ~F.coalesce(good, F.lit(False)), "bad create args").when((name == "create_event") & known, "event already exists").when(name == "create_event", "ok")
            .when((name == "cancel_event") & ~known, "no such event").when(name == "cancel_event", "ok")
            .when((name == "move_event") & ~(known & F.coalesce(day, F.lit(False))), "cannot move").when(name == "move_event", "ok")
            .otherwise(F.concat(F.lit("unknown tool "), name))
        )
        ok = reason == "ok"
        line = F.struct(c["title"].alias("title"), c["day"].alias("day"))
        moved = F.transform(s["events"], lambda x: F.struct(x["title"].alias("title"), F.when(x["title"] == c["title"], c["day"]).otherwise(x["day"]).alias("day")))
        events = F.when(ok & (name == "create_event"), F.concat(s["events"], F.array(line))).when(ok & (name == "cancel_event"), F.filter(s["events"], lambda x: x["title"] != c["title"])).when(ok & (name == "move_event"), moved).otherwise(s["events"])
        return _ok(s, ok, reason, events=events)

    return F.aggregate(calls, zero, step)


def describe_cart(state: Column) -> Column:
    lines = F.array_join(F.transform(state["items"], lambda x: F.concat(x["quantity"].cast("string"), F.lit(" "), x["item"])), ", ")
    return F.when(F.size(state["items"]) == 0, "the cart is empty").otherwise(F.concat(F.lit("cart: "), lines))


def describe_calendar(state: Column) -> Column:
    lines = F.array_join(F.transform(state["events"], lambda x: F.concat(x["title"], F.lit(" on "), x["day"])), ", ")
    return F.when(F.size(state["events"]) == 0, "the calendar is empty").otherwise(F.concat(F.lit("calendar: "), lines))
