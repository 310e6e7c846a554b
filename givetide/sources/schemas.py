"""Warehouse tables and the columns read from them.

Each entry maps a role to its warehouse table and lists ``column -> (name here, type)``.
A site whose tables or columns have other names gives ``open_warehouse`` a map of them. Money is
decimal(19,4), a date key is int yyyymmdd, a month is int yyyymm.
"""

from __future__ import annotations

MONEY = "decimal(19,4)"

TABLES: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "gift": ("FACT_Gift", {
        "GiftFactID": ("gift_id", "bigint"),
        "GiftSystemID": ("gift_system_id", "bigint"),
        "ConstituentDimID": ("constituent_key", "bigint"),
        "GiftTypeDimID": ("gift_type_id", "int"),
        "GiftStatusDimID": ("gift_status_id", "int"),
        "GiftCodeDimID": ("gift_code_id", "int"),
        "PaymentTypeDimID": ("payment_type_id", "int"),
        "AudienceDimID": ("audience_id", "int"),
        "TeamDimID": ("team_id", "int"),
        "AppealDimID": ("appeal_id", "int"),
        "PackageDimID": ("package_id", "bigint"),
        "CampaignDimID": ("campaign_id", "int"),
        "GiftDate": ("gift_date", "date"),
        "GiftDateDimID": ("gift_date_key", "int"),
        "ChangedDateDimID": ("changed_date_key", "int"),
        "Amount": ("amount", MONEY),
    }),
    "gift_change": ("FACT_GiftChange", {
        "GiftChangeFactID": ("change_id", "bigint"),
        "NewGiftFactID": ("gift_id", "bigint"),
        "ConstituentDimID": ("constituent_key", "bigint"),
        "Sequence": ("sequence", "int"),
        "IsOriginal": ("is_original", "int"),
        "GiftDateDimID": ("change_date_key", "int"),
        "Amount": ("amount", MONEY),
        "AnnualisedAmount": ("annual_amount", MONEY),
        "ChangeInAmount": ("change_amount", MONEY),
        "ChangeInAnnualisedAmount": ("change_annual_amount", MONEY),
        "InstallmentFrequencyDimID": ("frequency_id", "int"),
        "PreviousInstallmentFrequencyDimID": ("previous_frequency_id", "int"),
        "PackageDimID": ("package_id", "bigint"),
        "AppealDimID": ("appeal_id", "int"),
        "CampaignDimID": ("campaign_id", "int"),
    }),
    "gift_attribute": ("FACT_GiftAttribute", {
        "GiftFactID": ("gift_id", "bigint"),
        "AttributeCategory": ("attribute_category", "string"),
        "AttributeDescription": ("attribute_description", "string"),
    }),
    "action": ("FACT_Action", {
        "ActionFactID": ("action_id", "bigint"),
        "ActionSystemID": ("action_system_id", "bigint"),
        "ConstituentDimID": ("constituent_key", "bigint"),
        "ActionStatusDimID": ("action_status_id", "int"),
        "ActionTypeDimID": ("action_type_id", "int"),
        "ActionDateDimID": ("action_date_key", "int"),
        "ActionDate": ("action_date", "date"),
    }),
    "action_attribute": ("FACT_ActionAttribute", {
        "ActionFactID": ("action_id", "bigint"),
        "AttributeCategory": ("attribute_category", "string"),
        "AttributeDescription": ("attribute_description", "string"),
    }),
    "payment": ("FACT_Payment", {
        "PaymentSK": ("payment_id", "bigint"),
        "ConstituentSK": ("constituent_key", "bigint"),
        "DonationDateSK": ("donation_date_key", "int"),
        "Amount": ("amount", MONEY),
    }),
    "activity": ("FACT_Activity", {
        "ActivitySK": ("activity_id", "bigint"),
        "ActivityDimensionSK": ("activity_kind_id", "bigint"),
        "ToRecipient_ConstituentSK": ("recipient_key", "bigint"),
        "Sender_ConstituentSK": ("sender_key", "bigint"),
        "ActualEnd_DateSK": ("end_date_key", "int"),
    }),
    "constituent": ("DIM_Constituent", {
        "ConstituentDimID": ("constituent_key", "bigint"),
        "ConstituentID": ("constituent_id", "bigint"),
        "KeyIndicator": ("key_indicator", "string"),
        "IsDeceased": ("is_deceased", "string"),
        "DeceasedDate": ("deceased_date", "date"),
        "DateChanged": ("date_changed", "date"),
    }),
    "constituent_code": ("DIM_ConstituentConstitCode", {
        "ConstituentDimID": ("constituent_key", "bigint"),
        "ConstituentCode": ("constituent_code", "string"),
    }),
    "appeal": ("DIM_Appeal", {
        "AppealDimID": ("appeal_id", "int"),
        "AppealIdentifier": ("appeal_identifier", "string"),
        "AppealDescription": ("appeal_description", "string"),
        "AppealCategoryDescription": ("appeal_category", "string"),
        "Product": ("product", "string"),
        "CampaignDimID": ("campaign_id", "int"),
        "CampaignDescription": ("campaign_description", "string"),
    }),
    "appeal_attribute": ("DIM_AppealAttribute", {
        "AppealDimID": ("appeal_id", "int"),
        "AttributeCategory": ("attribute_category", "string"),
        "AttributeDescription": ("attribute_description", "string"),
    }),
    "campaign": ("DIM_Campaign", {
        "CampaignDimID": ("campaign_id", "int"),
        "CampaignIdentifier": ("campaign_identifier", "string"),
        "CampaignDescription": ("campaign_description", "string"),
    }),
    "package": ("DIM_Package", {
        "PackageDimID": ("package_id", "bigint"),
        "PackageIdentifier": ("package_identifier", "string"),
        "PackageDescription": ("package_description", "string"),
        "PackageCategoryDescription": ("package_category", "string"),
    }),
    "audience": ("DIM_Audience", {"AudienceDimID": ("audience_id", "int"), "Audience": ("audience", "string")}),
    "team": ("DIM_Team", {"TeamDimID": ("team_id", "int"), "Team": ("team", "string")}),
    "gift_code": ("DIM_GiftCode", {
        "GiftCodeDimID": ("gift_code_id", "int"),
        "Description": ("gift_code_description", "string"),
    }),
    "gift_status": ("DIM_GiftStatus", {"GiftStatusDimID": ("gift_status_id", "int"), "GiftStatus": ("gift_status", "string")}),
    "payment_type": ("DIM_PaymentType", {
        "PaymentTypeDimID": ("payment_type_id", "int"),
        "PaymentType": ("payment_type", "string"),
    }),
    "instalment_frequency": ("DIM_InstallmentFrequency", {
        "InstallmentFrequencyDimID": ("frequency_id", "int"),
        "InstallmentCountPerYear": ("instalments_per_year", "int"),
    }),
    "action_status": ("DIM_ActionStatus", {
        "ActionStatusDimID": ("action_status_id", "int"),
        "Description": ("action_status", "string"),
    }),
    "action_type": ("DIM_ActionType", {
        "ActionTypeDimID": ("action_type_id", "int"),
        "Description": ("action_type", "string"),
    }),
    "material_sent": ("DIM_MaterialSent", {
        "MaterialSentSK": ("material_id", "bigint"),
        "Item": ("item", "string"),
        "Quantity": ("quantity", "bigint"),
        "ActivitySK_Letter": ("letter_activity_id", "bigint"),
    }),
    "gift_status_date": ("GiftStatusDate", {
        "System Record ID": ("gift_system_id", "bigint"),
        "Gift Status": ("status", "string"),
        "Gift Status Date": ("status_date", "date"),
    }),
    "action_extra": ("ActionExtraInfo", {
        "Action System Record ID": ("action_system_id", "bigint"),
        "Action Date Added": ("date_added", "date"),
    }),
    "rg_fact": ("RegularGiftFacts", {
        "GiftFactID": ("gift_id", "bigint"),
        "First_Installment_Date": ("first_instalment_date", "date"),
        "GiftStatus": ("gift_status", "string"),
        "GiftHasBeenUpgraded": ("has_been_upgraded", "string"),
        "AnnualAmount": ("annual_amount", MONEY),
    }),
    "cash_gift": ("CashGifts", {
        "GiftFactID": ("gift_id", "bigint"),
        "ConstituentID": ("constituent_id", "bigint"),
        "GiftDate": ("gift_date", "date"),
        "GiftAmount": ("gift_amount", MONEY),
        "IsCounted": ("is_counted", "string"),
    }),
    "rg_income": ("RegularGiftIncome", {
        "CalendarYearMonth": ("month", "int"),
        "CampaignDescriptor": ("descriptor", "string"),
        "PaymentType": ("payment_type", "string"),
        "BeforeOrAfterApril": ("started", "string"),
        "AmendedThisFYOrNot": ("amended", "string"),
        "GiftCode": ("gift_code", "string"),
        "Value": ("value", MONEY),
    }),
    "known_descriptor": ("KnownDescriptors", {
        "CampaignDescriptor": ("descriptor", "string"),
        "DefaultGroupingID": ("default_group", "int"),
        "RuleNumberToApply": ("rule_number", "int"),
    }),
    "group": ("ReportingGroups", {
        "ID": ("group_id", "int"),
        "Description": ("description", "string"),
        "FormsPartOf": ("forms_part_of", "int"),
        "Level": ("level", "int"),
    }),
    "target": ("Targets", {
        "Type": ("type", "string"),
        "CalendarYearMonth": ("month", "int"),
        "ID": ("group_id", "int"),
        "FormsPartOf": ("forms_part_of", "int"),
        "Level": ("level", "int"),
        "Description": ("description", "string"),
        "Target": ("target", MONEY),
    }),
    "appeal_send": ("ConstituentAppeals", {
        "ConstituentID": ("constituent_id", "bigint"),
        "AppealIdentifier": ("appeal_identifier", "string"),
        "AppealDate": ("appeal_date", "date"),
    }),
    "nonfinancial_target": ("NonFinancialTargets", {
        "Team": ("team", "string"),
        "Target_Category": ("target_category", "string"),
        "Target_Description": ("target_description", "string"),
        "SubCategory_as_provided": ("subcategory", "string"),
        "CalendarYearMonth": ("month", "int"),
        "Target_Value": ("target_value", MONEY),
    }),
}

# The newer warehouse generation names the constituent differently; the two are never mixed.
NEWER_CONSTITUENT = ("DIM_Constituent", {
    "ConstituentSK": ("constituent_key", "bigint"),
    "KeyIndicator": ("key_indicator", "string"),
    "Organisation_Type": ("organisation_type", "string"),
    "Organisation_Category": ("organisation_category", "string"),
    "Organisation_Diocese": ("organisation_diocese", "string"),
    "Organisation_Name": ("organisation_name", "string"),
})

# Result tables, fully replaced by each run.
RESULTS = {
    "event_signups": "EventSignUps",
    "pack_sends": "PackRequests",
    "ytd_results": "DashboardResults",
    "long_term_trends": "LongTermTrends",
    "retention_by_mandate_age": "RetentionByMandateStart",
    "file_size_actuals": "FileSizeActuals",
    "crossed_giving": "CrossedGiving",
    "active_gift_value_by_group": "ActiveGiftsByGroup",
    "pack_requests_vs_target": "PackRequestsAgainstTarget",
    "faith_groups_vs_target": "FaithGroupsAgainstTarget",
}
