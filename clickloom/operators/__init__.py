"""Builders from DataFrames and policies to DataFrames; none runs an action unless it says so."""
