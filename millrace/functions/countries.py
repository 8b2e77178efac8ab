"""Country spellings to ISO 3166-1 alpha-3 codes."""

from __future__ import annotations

from pyspark.sql import Column

from millrace.functions.text import lookup, strip_ws

# Every accepted spelling per code, letter case matters.
SPELLINGS = {
    "USA": ("USA", "U.S.A.", "United States", "united states of america", "us", "America"),
    "CAN": ("Canada", "CA", "canada"),
    "MEX": ("Mexico", "MEX", "mexico"),
    "BRA": ("Brazil", "Brasil", "BR"),
    "ARG": ("Argentina", "argentina", "AR"),
    "GBR": ("UK", "United Kingdom", "Great Britain", "England"),
    "IRL": ("Ireland", "Republic of Ireland", "IE"),
    "FRA": ("France", "FR", "france"),
    "DEU": ("Germany", "Deutschland", "DE"),
    "ESP": ("Spain", "España", "ES"),
    "ITA": ("Italy", "Italia", "IT"),
    "NLD": ("Netherlands", "Holland", "The Netherlands"),
    "CHE": ("Switzerland", "Schweiz", "CH"),
    "SWE": ("Sweden", "sweden", "SE"),
    "IND": ("India", "IND", "india", "Bharat"),
    "CHN": ("China", "PRC", "People's Republic of China"),
    "JPN": ("Japan", "JP", "japan"),
    "KOR": ("South Korea", "Korea, Republic of", "Republic of Korea"),
    "SGP": ("Singapore", "SG", "singapore"),
    "ARE": ("UAE", "United Arab Emirates", "U.A.E."),
    "SAU": ("Saudi Arabia", "KSA", "saudi arabia"),
    "ZAF": ("South Africa", "RSA", "south africa"),
    "NGA": ("Nigeria", "nigeria", "NG"),
    "EGY": ("Egypt", "egypt", "EG"),
    "AUS": ("Australia", "AU", "Aus"),
    "NZL": ("New Zealand", "NZ", "new zealand"),
}
CODES = tuple(SPELLINGS)
CODE_OF = {spelling: code for code, names in SPELLINGS.items() for spelling in names}


def iso_country(c: Column | str) -> Column:
    """Alpha-3 code of a spelling, white space around it ignored; null when it is not known.

    The table is fixed and small, so it travels in the plan and needs no join.
    """
    return lookup(strip_ws(c), CODE_OF, "string")
