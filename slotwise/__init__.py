"""slotwise: appointment-booking analytics on Spark."""
