"""The sites and terms that are searched where none are given."""

from __future__ import annotations

from .requests import Site

# The search pages of two boards, one for each kind of work, and the terms.
BOARD_A_SEARCH = "https://www.alljobs.co.il/SearchResultsGuest.aspx?freetxt={query}&page={page}&position=&type=%s&city=&region="
BOARD_B_SEARCH = "https://www.gotfriends.co.il/jobslobby/%s/?page={page}"
SITES = (
    *(Site("AllJobs", BOARD_A_SEARCH % kind, "board_a") for kind in ("", "14", "33")),
    *(Site("GotFriends", BOARD_B_SEARCH % kind, "board_b") for kind in ("software/cplusplus-programmer", "software/real-time-engineerembedded-engineer", "system/linux-system", "software/graduate-with-high-honors")),
)
TERMS = ("student software developer", "junior C++ developer", "junior Linux developer", "junior embedded developer", "entry level systems programmer", "student backend developer", "junior cloud engineer", "junior infrastructure engineer")
LISTINGS_PER_CYCLE, HISTORY_SIZE, INTERVAL_HOURS = 100, 700, 24.0
