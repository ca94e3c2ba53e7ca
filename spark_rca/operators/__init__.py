"""DataFrame operators; every relation carries incident_id and service ids are 1-based."""
