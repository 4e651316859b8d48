"""Names of sets, matrices and columns, and the schemas of the tables a model is made of."""

from __future__ import annotations

import re

#: The letter of each set and its name.
SETS = {"r": "Region", "s": "Sector", "a": "Activity", "c": "Commodity", "f": "Factor of production", "k": "Satellite account", "n": "Consumption category"}
#: Other names under which sets are asked for; compared without case, spaces and marks.
ALIASES = {
    "Region": ["region", "regions", "country", "countries"], "Sector": ["sector", "sectors"], "Activity": ["activity", "activities"],
    "Commodity": ["commodity", "commodities", "product", "products"], "Factor of production": ["factor", "factors", "factorofproduction", "valueadded"],
    "Satellite account": ["satellite", "satellites", "satelliteaccount", "extension", "extensions"], "Consumption category": ["category", "categories", "consumptioncategory", "finaldemand"],
}
#: Fixed values: "industry" is the sector of an input-output table and the activity of a supply-use table.
INDUSTRY, INDUSTRIES = ["industry", "industries"], {"IOT": "Sector", "SUT": "Activity"}
LEVELS = {"IOT": ("Sector",), "SUT": ("Activity", "Commodity")}
#: Flow matrices that a model is parsed from, and the coefficient form of those that have one. Names keep their case, so they are data, not identifiers.
FLOWS = {"IOT": ("Z", "Y", "V", "E", "EY", "VY"), "SUT": ("U", "S", "Ya", "Yc", "Va", "Vc", "Ea", "Ec", "EY", "VY")}
COEFFICIENTS = {"IOT": ("z", "Y", "v", "e", "EY", "VY"), "SUT": ("u", "s", "Ya", "Yc", "va", "vc", "ea", "ec", "EY", "VY")}
BASELINE = "baseline"
#: Labelled cells, the form in which tables come in and go out.
LABELLED = "scenario string, matrix string, region_from string, level_from string, item_from string, region_to string, level_to string, item_to string, value double"
CELLS = "scenario string, matrix string, i long, j long, value double"
AXIS = "id long, region string, level string, item string"
UNITS = "level string, item string, unit string"
MAPS = "level string, source string, target string"
#: The columns of a flat file, by side.
FLAT_SETS = ("Region", "Sector", "Activity", "Commodity", "Factor of production", "Satellite account", "Consumption category")


class WrongInput(ValueError):
    """What was asked for can't be read."""


class NotComputable(ValueError):
    """What was asked for can't be made from the blocks at hand."""


def token(text: str) -> str:
    """Lower case, letters and digits only."""
    return re.sub(r"[^a-z0-9]", "", text.strip().lower())


def set_name(asked: str, kind: str = "SUT") -> str:
    """The set that a name, a letter or an alias stands for in a kind of table."""
    if asked in SETS:
        return SETS[asked]
    t = token(asked)
    if t in INDUSTRY:
        return INDUSTRIES[kind]
    for name, others in ALIASES.items():
        if t == token(name) or t in others:
            return name
    raise WrongInput(f"no set is called {asked!r}")


def role(matrix: str) -> str:
    """flow, coefficient, operator or result."""
    if matrix[0] in "wgb":
        return "operator"
    if matrix[0] in "XMFp":
        return "result"
    return "flow" if matrix[0].isupper() else "coefficient"
