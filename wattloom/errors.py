"""Errors that callers can tell apart; each says what was asked and what there is."""

from __future__ import annotations


class WattloomError(ValueError):
    """Base of all errors here. Subclasses give a message template for their keyword arguments."""

    template = "{detail}"

    def __init__(self, **about) -> None:
        self.__dict__.update(about)
        super().__init__(self.template.format(**about))


# scenarios


class InvalidScenario(WattloomError):
    pass


class EmptyScenario(InvalidScenario):
    template = "Scenario cannot be empty"


class InvalidUpgradeId(InvalidScenario):
    template = "Upgrade ID must be a non-negative integer, got: {upgrade}"


class UnequalYears(InvalidScenario):
    template = "All upgrade adoption lists must have the same length. Got lengths: {lengths}"


class NoYears(InvalidScenario):
    template = "Adoption lists must have at least one year"


class FractionOutOfRange(InvalidScenario):
    template = "Adoption fractions must be in [0, 1]; upgrade {upgrade} has {fraction} in year {year}"


class FallingAdoption(InvalidScenario):
    template = "Adoption must be non-decreasing; upgrade {upgrade} falls from {before} to {after} in year {year}"


class TotalAboveOne(InvalidScenario):
    template = "Total adoption {total} in year {year} exceeds 1.0: {parts}"


class MissingScenario(InvalidScenario):
    template = "A scenario parameter is required"


class WeightsOfOthers(InvalidScenario):
    template = "Weights must match upgrade_ids {upgrades}, got: {weights}"


class WeightOutOfRange(InvalidScenario):
    template = "Weights must be in [0, 1], got: {weights}"


class WeightsSum(InvalidScenario):
    template = "Weights must sum to 1.0, got: {weights}"


class EmptyTrajectory(InvalidScenario):
    template = "Adoption trajectory cannot be empty"


class YearOutOfRange(WattloomError):
    template = "Year index {year} is out of range. Valid range: [0, {most}]"


# catalogue and lake


class NoReleasesLeft(WattloomError):
    template = "No release matches {wanted}"


class MoreThanOneRelease(WattloomError):
    template = "More than one release matches {wanted}: {found}"


class UnknownName(WattloomError):
    template = "{value!r} is not a known {kind}"


class DataNotFound(WattloomError):
    template = "No {file_type} data below {path}"


class UpgradesNotInRelease(WattloomError):
    template = "Upgrades {upgrades} are not in release {release}"


class UpgradesNotFound(DataNotFound):
    template = "Missing {file_type} data for upgrades: {upgrades}"


class BaselineNotFound(DataNotFound):
    template = "No baseline (upgrade 0) metadata below {path}"


class NoBuildings(WattloomError):
    template = "No buildings to sample from"


class UpgradesOfNoRelease(WattloomError):
    template = "Buildings with upgrades that their release does not have: {found}"


class UnavailableFileType(WattloomError):
    template = "Release {release} has no {file_type}"


class InvalidPath(WattloomError):
    template = "Not a lake file path: {path}"


# aggregation, quality, vehicles


class UnknownAggregation(WattloomError):
    template = "Unknown aggregation function(s): {names}"


class UnruledColumns(WattloomError):
    template = "No aggregation rule for columns: {columns}"


class InvalidIds(WattloomError):
    template = "Column {column}: {nulls} of {rows} ids are null or not whole numbers"


class NullInputs(WattloomError):
    template = "Null inputs in {columns} for buildings {ids}"


class UnseenLabels(WattloomError):
    template = "Labels not seen in fitting: {labels}"


class InvalidDates(WattloomError):
    template = "Dates must be YYYY-MM-DD with the start before the end; got {start} and {end}"
