"""DataFrame operators. Every one keeps ``recording_id`` as the outer key."""
