"""Readers, writers and adapters from the driver's tables to the dialogue
data model."""
