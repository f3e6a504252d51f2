"""Raw records of the tests: complete ones, and one table that meets every rule of the cleaning."""

from __future__ import annotations

PLAY = {
    "Title": "Harbour Lights", "US Gross": 31_000_000, "Worldwide Gross": 64_500_000, "US DVD Sales": None,
    "Production Budget": 12_500_000, "Release Date": "Mar 4 1994", "MPAA Rating": "PG-13", "Running Time min": 97,
    "Distributor": "Northgate Pictures", "Source": "Based on Play", "Major Genre": "Drama", "Creative Type": "Historical Fiction",
    "Director": "Mara Lindqvist", "Rotten Tomatoes Rating": 71, "IMDB Rating": 6.8, "IMDB Votes": 41_300,
}


def record(**changes):
    """A complete record with some fields changed; underscores stand for spaces."""
    return PLAY | {name.replace("_", " "): value for name, value in changes.items()}


def dated(title, date, **changes):
    return record(Title=title, Release_Date=date, **changes)


#: Each rule of the cleaning is met by at least one record; three remakes, two exact copies, one record without a title.
RECORDS = [
    {name: None for name in PLAY} | {"Title": "Quiet Acre", "Release Date": "Jul 19 1989"},
    record(),
    dated(None, "Apr 11 1996"),
    dated(2112, "May 21 1999"),
    record(),
    dated("\tGlass   Orchard ", "Sep 30 1992"),
    dated("The Ferry", "Feb 2 1951"),
    dated("Lantern Street", "Aug 15 2031"),
    dated("The Ferry", "Oct 13 1978"),
    dated("Paper Sail", "Nov 5 2018"),
    dated("Broken Figures", "Jan 27 1997", IMDB_Rating=-0.5, Rotten_Tomatoes_Rating=250, Production_Budget=-7,
          Worldwide_Gross=-2, Running_Time_min=-30),
    dated("Sundial", "sometime in spring"),
    dated("Open Water Mill", "Dec 24 2001", MPAA_Rating="Open"),
    dated("Open Water Mill", "Dec 24 2001", MPAA_Rating="Open"),
    dated("Winter Ledger", "Feb 18 2005", Rotten_Tomatoes_Rating=18, IMDB_Rating=5.9, Production_Budget=3_000_000,
          Worldwide_Gross=1_200_000),
    dated("The Ferry", "Jun 1 2003"),
]
ROWS_OUT = 13
