"""The coverage rules once more, one fill at a time in plain Python."""

from collections import defaultdict
from datetime import timedelta


def by_patient_drug(spans, order):
    groups = defaultdict(list)
    for person, drug, number, start, end in spans:
        groups[person, drug].append((start, end, number))
    return {key: sorted(rows, key=order) for key, rows in groups.items()}


def periods(rows):
    """Merged periods as [start, end, fills] of rows sorted by (start, end, id)."""
    merged, reached = [], None
    for start, end, _ in rows:
        if reached is None or start > reached + timedelta(1):
            merged.append([start, end, 1])
        else:
            merged[-1][0] = min(merged[-1][0], start)
            merged[-1][1] = max(merged[-1][1], end)
            merged[-1][2] += 1
        reached = end if reached is None else max(reached, end)
    return merged


def totals(covered, fills, gaps, first, last):
    return {
        "total_days_covered": covered,
        "total_fills": fills,
        "num_gaps": sum(gap > 0 for gap in gaps),
        "total_gap_days": sum(gaps),
        "max_gap_days": max(gaps),
        "first_exposure_date": first,
        "last_exposure_date": last,
        "treatment_duration": (last - first).days + 1,
    }


def merged(spans):
    result = {}
    for key, rows in by_patient_drug(spans, lambda r: r).items():
        found = periods(rows)
        gaps = [(after[0] - before[1]).days - 1 for before, after in zip(found, found[1:])] + [0]
        result[key] = totals(
            sum((end - start).days + 1 for start, end, _ in found),
            len(rows),
            gaps,
            min(p[0] for p in found),
            max(p[1] for p in found),
        )
        result[key]["num_periods"] = len(found)
    return result


def adjusted_rows(rows):
    """(id, position, previous end, gap, overlap, adjusted days) of rows sorted by (start, end, id)."""
    previous, result = None, []
    for position, (start, end, number) in enumerate(rows, 1):
        gap = overlap = 0
        days = (end - start).days + 1
        if previous is not None and start > previous:
            gap = (start - previous).days - 1
        elif previous is not None:
            overlap = (previous - start).days
            days = max(0, (end - previous).days)
        result.append((number, position, previous, gap, overlap, days))
        previous = end
    return result


def adjusted(spans):
    result = {}
    for key, rows in by_patient_drug(spans, lambda r: r).items():
        steps = adjusted_rows(rows)
        result[key] = totals(
            sum(step[5] for step in steps),
            len(rows),
            [step[3] for step in steps],
            min(r[0] for r in rows),
            max(r[1] for r in rows),
        )
    return result


def neighbours(spans):
    """{id: (sequence, next start, next id)} in order of start and id."""
    result = {}
    for rows in by_patient_drug(spans, lambda r: (r[0], r[2])).values():
        for position, row in enumerate(rows):
            after = rows[position + 1] if position + 1 < len(rows) else (None, None, None)
            result[row[2]] = (position + 1, after[0], after[2])
    return result
