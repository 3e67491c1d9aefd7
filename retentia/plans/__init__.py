"""The named queries (registry) and their independent SQL oracles (oracle)."""
