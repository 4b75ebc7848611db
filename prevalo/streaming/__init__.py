"""Cohorts kept up to date as claims files arrive."""

from prevalo.streaming.incremental import compact_first_years, first_years, update_first_years

__all__ = ["compact_first_years", "first_years", "update_first_years"]
