"""Tables spoilt in the styles of the public benchmarks, with their truth, from the values of the given tables."""

import random

import pandas as pd

SF = "/root/testdata/sf0.01"


def stars():
    read = lambda name: pd.read_parquet(f"{SF}/{name}.parquet")
    customer = read("customer").merge(read("nation"), left_on="c_nationkey", right_on="n_nationkey").merge(read("region"), left_on="n_regionkey", right_on="r_regionkey")
    return customer.sort_values("c_custkey", ignore_index=True), read("part"), read("orders")


def spoilt(truth, share, style):
    """Each cell spoilt by its column's style with a chance of ``share``; the truth as text."""
    draw, truth = random.Random(11), truth.astype(object).where(truth.notna(), None)
    dirty = truth.copy()
    for c in truth.columns:
        if c in style:
            dirty[c] = [style[c](v, draw, i) if v is not None and draw.random() < share else v for i, v in enumerate(truth[c])]
    return dirty, truth


def masked(v, draw, i):
    """One letter or digit replaced by an x."""
    at = draw.choice([k for k, ch in enumerate(v) if ch.isalnum()])
    return v[:at] + "x" + v[at + 1 :]


def hospital():
    """Repeated facts about providers; x for letters, ``empty``, and percent signs where the truth has numbers."""
    customer, _, _ = stars()
    k = customer["c_nationkey"]
    conditions = ["heart attack", "heart failure", "pneumonia", "surgical infection prevention"]
    truth = pd.DataFrame({
        "ProviderNumber": (10001 + 17 * k).astype(str), "HospitalName": customer["n_name"].str.lower() + " medical center", "City": customer["n_name"].str.lower(),
        "State": customer["r_name"].str.lower(), "ZipCode": (35000 + 131 * k).astype(str), "PhoneNumber": (2053250000 + 104729 * k).astype(str),
        "Condition": [conditions[i % 4] for i in customer["c_custkey"]], "MeasureCode": [f"scip-inf-{i % 9 + 1}" for i in customer["c_custkey"]],
        "EmergencyService": ["yes" if i % 3 else "no" for i in customer["c_custkey"]], "Score": [str(i * 37 % 100) for i in customer["c_custkey"]],
    })
    style = {c: masked for c in ("ProviderNumber", "HospitalName", "City", "State", "ZipCode", "PhoneNumber", "Condition", "MeasureCode")}
    dirty, truth = spoilt(truth, 0.05, style)
    truth.loc[truth.index % 40 == 3, "Score"] = None
    dirty["Score"] = ["empty" if v is None else f"{v}%" for v in truth["Score"]]
    return dirty, truth


def beers():
    """A number with a unit where the truth has a number, written in several ways; percent signs, the state written behind the city, and missing states."""
    customer, part, _ = stars()
    n = len(part)
    shop = [customer["n_name"].str.title()[i % 25 * 7] for i in range(n)]
    truth = pd.DataFrame({
        "id": [str(i) for i in range(1, n + 1)], "ounces": [f"{v % 5 * 4 + 8}.0" for v in part["p_size"]], "abv": [f"{(v % 9 + 3) / 100:.3f}" for v in part["p_size"]],
        "brewery_id": [str(i % 25 + 400) for i in range(n)], "city": shop, "state": [f"S{s[-2:].strip('_').upper()}" for s in shop],
    })
    style = {
        "abv": lambda v, draw, i: v + "%",
        "city": lambda v, draw, i: f"{v} S{v[-2:].strip('_').upper()}",
        "state": lambda v, draw, i: draw.choice([None, "N/A"]),
    }
    dirty, truth = spoilt(truth, 0.06, style)
    draw = random.Random(5)
    dirty["ounces"] = [v + draw.choice([" oz"] * 9 + [" oz.", "oz", " ounce", " OZ"]) for v in truth["ounces"]]
    return dirty, truth


def movies():
    """Dates with a country, grouped counts, numbers with units, and marks for null."""
    _, _, orders = stars()
    o = orders.head(3000)
    truth = pd.DataFrame({
        "Id": [f"tt{k:07d}" for k in o["o_orderkey"]], "Release Date": o["o_orderdate"].dt.strftime("%-d %B %Y"), "Duration": [str(80 + int(k) % 70) for k in o["o_custkey"]],
        "RatingCount": [str(1000 + int(k) * 7919 % 90000) for k in o["o_orderkey"]], "Genre": [["Drama", "Comedy", "Action", "Horror"][int(k) % 4] for k in o["o_custkey"]],
    })
    style = {
        "Release Date": lambda v, draw, i: v + " (USA)",
        "RatingCount": lambda v, draw, i: f"{int(v):,}",
        "Genre": lambda v, draw, i: draw.choice([v.lower(), v + " ", "{NULL}", v[:-1]]),
    }
    dirty, truth = spoilt(truth, 0.06, style)
    truth.loc[dirty["Genre"] == "{NULL}", "Genre"] = None
    draw = random.Random(6)
    dirty["Duration"] = [v + draw.choice([" min"] * 9 + ["min", " min.", " minutes"]) for v in truth["Duration"]]
    return dirty, truth


def rayyan():
    """Languages, journals, issue numbers and dates; sentinels and null marks."""
    _, _, orders = stars()
    o = orders.iloc[3000:5000]
    names = {"Am J Med": "0002-9343", "Lancet Oncol": "1470-2045", "BMJ Open": "2044-6055", "J Clin Oncol": "0732-183X"}
    journal = [list(names)[int(k) % 4] for k in o["o_custkey"]]
    truth = pd.DataFrame({
        "article_language": [["eng", "ger", "fre"][int(k) % 3] for k in o["o_orderkey"]], "journal_title": journal, "journal_issn": [names[j] for j in journal],
        "article_jissue": [str(int(k) % 12 + 1) for k in o["o_custkey"]], "article_jcreated_at": o["o_orderdate"].dt.strftime("%m/%d/%Y"),
    })
    style = {
        "article_language": lambda v, draw, i: draw.choice(["{NULL}", v.upper()]),
        "journal_title": lambda v, draw, i: draw.choice([v + "l", v.replace(" ", "  "), v.lower()]),
        "journal_issn": lambda v, draw, i: v.replace("-", ""),
        "article_jcreated_at": lambda v, draw, i: f"{v[6:]}-{v[:2]}-{v[3:5]}",
    }
    dirty, truth = spoilt(truth, 0.06, style)
    truth.loc[dirty["article_language"] == "{NULL}", "article_language"] = None
    return dirty, truth


TABLES = {f.__name__: f for f in (hospital, beers, movies, rayyan)}
