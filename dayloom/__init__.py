"""dayloom: Spark operators for longitudinal (entity, day) panels."""
