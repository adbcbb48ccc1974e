"""Readers and writers for dataset folders, inventories and log directories."""
