"""ticketspark: support-ticket analytics as functions from DataFrames to DataFrames."""
