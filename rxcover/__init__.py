"""Medication-adherence analytics over OMOP-style tables, as Spark DataFrames."""

from rxcover.analysis import PROFILES, AdherenceAnalysis, Profile
from rxcover.sources.cdm import CdmTables

__all__ = ["PROFILES", "AdherenceAnalysis", "CdmTables", "Profile"]
