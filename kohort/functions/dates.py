"""Date arithmetic for cohort variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kohort.functions.nulls import _c


def as_date(v) -> Column:
    return v if isinstance(v, Column) else F.lit(str(v)).cast("date")


def _d(v) -> Column:
    """Column, column name, or ISO date literal ("2020-03-03")."""
    if isinstance(v, str) and v[:1].isdigit():
        return as_date(v)
    return _c(v)


def days_between(a, b) -> Column:
    """Whole days from ``a`` to ``b`` (may be negative; NULL if either is)."""
    return F.datediff(_d(b), _d(a)).cast("bigint")


def years_between(a, b, year_days: float = 365.25) -> Column:
    """Completed years: floor(days / 365.25) (a double literal keeps it
    out of decimal arithmetic)."""
    return F.floor(F.datediff(_c(b), _c(a)) / F.lit(float(year_days))).cast("bigint")


def age_by_year(ref_year: int, birth) -> Column:
    """Calendar-year difference (not birthday exact)."""
    return (F.lit(int(ref_year)) - F.year(_c(birth))).cast("bigint")


def in_year_flag(flag_cond: Column, date, year: int, yes=1, no=0) -> Column:
    """``yes`` when the event test holds and its date falls in ``year``,
    else ``no``; a NULL test or date counts as ``no`` (missing = no)."""
    cond = flag_cond & (F.year(_c(date)) == year)
    return F.when(F.coalesce(cond, F.lit(False)), yes).otherwise(no)


def clamp_entry(dx, study_start) -> Column:
    """Cohort entry = max(diagnosis, study start); NULL diagnosis -> NULL
    (``greatest`` would skip the NULL)."""
    s = as_date(study_start)
    return F.when(_c(dx) < s, s).when(_c(dx) >= s, _c(dx))


def cohort_exit(event_flag, event_date, died_flag, death_date, study_end) -> Column:
    """No event & alive -> study end; no event & died -> death date;
    event -> event date; anything else NULL."""
    e = as_date(study_end)
    return (F.when((_c(event_flag) == 0) & (_c(died_flag) == 0), e)
             .when((_c(event_flag) == 0) & (_c(died_flag) == 1), _c(death_date))
             .when(_c(event_flag) == 1, _c(event_date)))


def time_to_event(event_flag, event_date, origin, study_end) -> Column:
    """Days from ``origin`` to the event, or to ``study_end`` without one."""
    o, e = as_date(origin), as_date(study_end)
    return F.when(_c(event_flag) == 0, F.datediff(e, o)) \
            .otherwise(F.datediff(_c(event_date), o)).cast("bigint")
