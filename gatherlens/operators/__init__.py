"""DataFrame -> DataFrame operators; no actions, no driver-side loops."""
